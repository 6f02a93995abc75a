"""Tree tables: scoring, federation (tree union), summaries, importance, JSON documents.

Canonical form: ``trees(model, tree, node, depth, feature, threshold,
default_left, left, right, leaf_value, gain, cover)`` - one row per node,
heap-numbered (children of n are 2n+1 and 2n+2); a leaf has NULL feature.
A model's margin is the sum of the leaf values its trees give a sample
(base margin 0); the probability is sigmoid(margin).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sigmoid


def score_models(
    trees: DataFrame,
    rows: DataFrame,
    ids: Sequence[str] = ("study", "row_id"),
    models: Sequence[str] | None = None,
    per_tree: bool = False,
) -> DataFrame:
    """Margin and probability of every model on every row.

    A row walks all trees of its models in an Arrow batch (:mod:`sigspark.operators.forest`):
    ``x[feature] < threshold`` goes left, a missing value follows ``default_left``.
    The trees travel to the rows, in parts of bounded size; the rows do not move, unless
    several parts make a sum of partial margins necessary.
    Output: ids, model, margin, prob.

    The models are those of the tree table, those given, or,
    when ``rows`` has a ``models`` array column, those that each row lists (e.g.
    the models of its own CV fold).  ``per_tree`` returns one row per
    (ids, model, tree) with the tree's ``leaf``.
    """
    from .forest import score

    found = score(rows, trees, ids, models, per_tree)
    return found if per_tree else found.withColumn("prob", sigmoid("margin"))


def with_depth(trees: DataFrame) -> DataFrame:
    """Tree rows with ``depth``, found from the links between parents and children, whatever the node numbers.

    A root is a node that is no node's child.  One small join per level of the deepest tree.
    """
    from ..session import reuse

    t = reuse(trees)
    child = t.where("feature is not null").select("model", "tree", F.col("node").alias("parent"), F.explode(F.array("left", "right")).alias("node"))
    level = reuse(t.join(child, ["model", "tree", "node"], "left_anti").select("model", "tree", "node", F.lit(0).alias("depth")))
    found = level
    while level.take(1):
        level = reuse(child.join(level.withColumnRenamed("node", "parent"), ["model", "tree", "parent"]).select("model", "tree", "node", (F.col("depth") + 1).alias("depth")))
        found = found.unionByName(level)
    return t.join(found, ["model", "tree", "node"])


def merge_models(trees: DataFrame, name: str = "global") -> DataFrame:
    """Union of all local trees into one model, structures unchanged.

    Models are taken in name order; a tree's new id is its local id plus the
    number of trees of the models before it (window over the model table,
    one row per model).  ``tree_info`` (tree group) is 0 for every tree; the
    global margin is the sum of the local margins.
    """
    n = trees.groupBy("model").agg(F.countDistinct("tree").alias("n_trees"))
    w = Window.orderBy("model").rowsBetween(Window.unboundedPreceding, -1)
    off = n.withColumn("offset", F.coalesce(F.sum("n_trees").over(w), F.lit(0)))
    cols = [c for c in trees.columns if c not in ("model", "tree")]
    return trees.join(off.select("model", "offset"), "model").select(
        F.lit(name).alias("model"),
        (F.col("offset") + F.col("tree")).cast("int").alias("tree"),
        F.col("model").alias("source_model"),
        F.col("tree").alias("source_tree"),
        *cols,
        F.lit(0).alias("tree_info"),
    )


def model_summary(trees: DataFrame, fits: DataFrame | None = None) -> DataFrame:
    """Per model: trees, nodes, leaves, depth, features used (+ parameters when given)."""
    s = trees.groupBy("model").agg(
        F.countDistinct("tree").alias("num_trees"),
        F.count(F.lit(1)).alias("num_nodes"),
        F.count_if(F.col("feature").isNull()).alias("num_leaves"),
        F.max("depth").alias("max_depth"),
        F.countDistinct("feature").alias("num_features_used"),
    ).withColumn("num_parallel_tree", F.lit(1))
    if fits is not None:
        s = s.join(
            fits.select(
                F.col("fit_id").alias("model"), "eta", "colsample_bytree", "subsample",
                F.col("max_depth").alias("max_depth_param"),
            ),
            "model",
            "left",
        ).withColumn("lambda", F.lit(1.0)).withColumn("alpha", F.lit(0.0)).withColumn(
            "objective", F.lit("binary:logistic")
        )
    return s


def feature_importance(trees: DataFrame) -> DataFrame:
    """Gain, Cover and Frequency shares per (model, feature) over split nodes.

    Each measure sums to 1 within a model; features never used are absent.
    Totals per model come from a grouped aggregate joined back.
    """
    sp = trees.where(F.col("feature").isNotNull())
    per = sp.groupBy("model", "feature").agg(
        F.sum("gain").alias("g"), F.sum("cover").alias("c"), F.count(F.lit(1)).alias("f")
    )
    tot = sp.groupBy("model").agg(F.sum("gain").alias("gt"), F.sum("cover").alias("ct"), F.count(F.lit(1)).alias("ft"))
    return per.join(tot, "model").select(
        "model", "feature",
        (F.col("g") / F.col("gt")).alias("gain"),
        (F.col("c") / F.col("ct")).alias("cover"),
        (F.col("f") / F.col("ft")).alias("frequency"),
    )


# ---- JSON model documents ------------------------------------------------

TREE_STRUCT = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("left_children", T.ArrayType(T.IntegerType())),
        T.StructField("right_children", T.ArrayType(T.IntegerType())),
        T.StructField("split_indices", T.ArrayType(T.IntegerType())),
        T.StructField("split_conditions", T.ArrayType(T.DoubleType())),
        T.StructField("default_left", T.ArrayType(T.IntegerType())),
        T.StructField("loss_changes", T.ArrayType(T.DoubleType())),
        T.StructField("sum_hessian", T.ArrayType(T.DoubleType())),
    ]
)
DOC_SCHEMA = T.StructType(
    [
        T.StructField(
            "learner",
            T.StructType(
                [
                    T.StructField(
                        "gradient_booster",
                        T.StructType(
                            [
                                T.StructField(
                                    "model",
                                    T.StructType(
                                        [
                                            T.StructField(
                                                "gbtree_model_param",
                                                T.StructType(
                                                    [
                                                        T.StructField("num_trees", T.StringType()),
                                                        T.StructField("num_parallel_tree", T.StringType()),
                                                    ]
                                                ),
                                            ),
                                            T.StructField("trees", T.ArrayType(TREE_STRUCT)),
                                            T.StructField("tree_info", T.ArrayType(T.IntegerType())),
                                            T.StructField("iteration_indptr", T.ArrayType(T.IntegerType())),
                                        ]
                                    ),
                                )
                            ]
                        ),
                    )
                ]
            ),
        )
    ]
)


def model_to_json(trees: DataFrame) -> DataFrame:
    """One JSON document per model in the public boosted-tree model layout.

    Nodes are renumbered 0..n-1 per tree (heap ids sorted); leaves carry
    their value in ``split_conditions`` and -1 children.  Per-tree arrays
    come from a group of one tree, the document from a group of one model -
    both bounded by the model's own size.  Output: model, num_trees, json.
    """
    w = Window.partitionBy("model", "tree").orderBy("node")
    t = trees.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))
    ix = t.select("model", "tree", F.col("node").alias("child"), F.col("idx").alias("cidx"))
    t = (
        t.join(ix.withColumnRenamed("child", "left").withColumnRenamed("cidx", "lidx"), ["model", "tree", "left"], "left")
        .join(ix.withColumnRenamed("child", "right").withColumnRenamed("cidx", "ridx"), ["model", "tree", "right"], "left")
    )
    leaf = F.col("feature").isNull()
    node = F.struct(
        "idx",
        F.coalesce("lidx", F.lit(-1)).alias("l"),
        F.coalesce("ridx", F.lit(-1)).alias("r"),
        F.coalesce(F.col("feature"), F.lit(0)).cast("int").alias("f"),
        F.when(leaf, F.col("leaf_value")).otherwise(F.col("threshold")).alias("c"),
        F.when(F.col("default_left"), F.lit(1)).otherwise(F.lit(0)).alias("d"),
        F.coalesce(F.col("gain"), F.lit(0.0)).alias("lc"),
        F.col("cover").alias("sh"),
    )
    per_tree = t.groupBy("model", "tree").agg(F.sort_array(F.collect_list(node)).alias("ns"))
    tr = per_tree.select(
        "model",
        "tree",
        F.struct(
            F.col("tree").cast("int").alias("id"),
            F.col("ns.l").alias("left_children"),
            F.col("ns.r").alias("right_children"),
            F.col("ns.f").alias("split_indices"),
            F.col("ns.c").alias("split_conditions"),
            F.col("ns.d").alias("default_left"),
            F.col("ns.lc").alias("loss_changes"),
            F.col("ns.sh").alias("sum_hessian"),
        ).alias("t"),
    )
    per_model = tr.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("tree", "t"))).alias("ts"))
    n = F.size("ts")
    doc = F.struct(
        F.struct(
            F.struct(
                F.struct(
                    F.struct(n.cast("string").alias("num_trees"), F.lit("1").alias("num_parallel_tree")).alias(
                        "gbtree_model_param"
                    ),
                    F.col("ts.t").alias("trees"),
                    F.array_repeat(F.lit(0), n).alias("tree_info"),
                    F.sequence(F.lit(0), n).alias("iteration_indptr"),
                ).alias("model")
            ).alias("gradient_booster")
        ).alias("learner")
    )
    return per_model.select("model", n.alias("num_trees"), F.to_json(doc).alias("json"))


def parse_models(docs: DataFrame, text_col: str = "json", model_col: str = "model") -> DataFrame:
    """Model documents -> tree table (``from_json`` -> explode trees -> zip node arrays -> explode nodes).

    Children indices are kept as in the document (0..n-1, -1 for none); depth
    is not stored there, :func:`with_depth` finds it from the links.
    """
    d = docs.select(model_col, F.from_json(text_col, DOC_SCHEMA).alias("d"))
    t = d.select(model_col, F.explode("d.learner.gradient_booster.model.trees").alias("t"))
    z = t.select(
        model_col,
        F.col("t.id").alias("tree"),
        F.posexplode(
            F.arrays_zip(
                "t.left_children", "t.right_children", "t.split_indices", "t.split_conditions",
                "t.default_left", "t.loss_changes", "t.sum_hessian",
            )
        ).alias("node", "z"),
    )
    leaf = F.col("z.left_children") == -1
    return z.select(
        model_col,
        "tree",
        F.col("node").cast("int").alias("node"),
        F.when(~leaf, F.col("z.split_indices")).alias("feature"),
        F.when(~leaf, F.col("z.split_conditions")).alias("threshold"),
        F.when(~leaf, F.col("z.default_left") == 1).alias("default_left"),
        F.when(~leaf, F.col("z.left_children")).alias("left"),
        F.when(~leaf, F.col("z.right_children")).alias("right"),
        F.when(leaf, F.col("z.split_conditions")).alias("leaf_value"),
        F.when(~leaf, F.col("z.loss_changes")).alias("gain"),
        F.col("z.sum_hessian").alias("cover"),
    )


def write_models(docs: DataFrame, path: str) -> None:
    """One folder per model (``model=<name>``), one document per line; models that are not in ``docs`` stay.

    New folders take their place when the whole job has succeeded.
    """
    docs.select("model", "json").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").text(path)


def read_models(spark, path: str, wholetext: bool = False) -> DataFrame:
    """Read model documents: one per line (default) or one per file (``wholetext``).

    The model name is taken from a ``model=<name>`` folder when there is one
    (partition values are %-escaped on write; ``+`` is kept), else from the
    file name without extension.  Partition discovery is not used, so names
    are never re-typed.
    """
    fp = F.col("_metadata.file_path")
    part = F.regexp_extract(fp, r"model=([^/]+)/", 1)
    # the path is a URI (so %-escaped once more than the folder name), and the
    # folder name is Spark's %-escaped partition value: decode twice, keep '+'
    dec = lambda c: F.url_decode(F.regexp_replace(c, r"\+", "%2B"))
    name = F.when(part != "", dec(dec(part))).otherwise(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    )
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=wholetext)
    return parse_models(files.select(name.alias("model"), "value"), "value")
