import re

import pytest

from sigspark.llm import licenses
from sigspark.llm.queries import op6_license_scan


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_finds_itself(name):
    text = licenses.TEMPLATES[name]
    for block in (text, text.upper() + ".", f"See here: {text}, as said.", text.replace(" ", "\n", 3)):
        found, _, saved, share, lacks, _ = licenses.explain(block)
        assert licenses.TEMPLATES[found].startswith(text[:40]) and saved > 0.1 and share == 1 and lacks == ""


def test_differences_are_reported():
    name, version, _, share, lacks, more = licenses.explain("This work is licensed under the GNU General Public License, version 2 only.")
    assert (name, version, lacks, more) == ("GPL", "2", "3", "")
    assert 0.8 < share < 1
    assert licenses.explain("The driver has a license to drive.")[0] == "unknown"
    assert licenses.explain("Licensed under CC BY-SA 4.0.")[0] == "CC-BY-SA" and licenses.explain("Licensed under CC BY 3.0.")[:2] == ("CC-BY", "3.0")


def test_blocks():
    text = "a\nLicensed under x\nb\ncopyright y\n\n\n\nlicense z\nq"
    assert [(a, n) for a, n, _ in licenses.candidate_blocks(text)] == [(1, 3), (7, 1)]
    long = "word " * 5000 + "Released under the MIT License. " + "word " * 5000 + "Licensed under CC BY-NC 4.0." + " word" * 500
    found = [licenses.explain(b)[0] for _, _, b in licenses.candidate_blocks(long)]
    assert found == ["MIT", "CC-BY-NC"]
    assert list(licenses.candidate_blocks("")) == []


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""


@pytest.mark.parametrize("before", ["", "Some words here.\n", "Copyright (C) 2020 A. Writer\n\n", "x " * 5000 + "\n"])
def test_wrapped_notices(before):
    for text, name, start in ((MIT, "MIT text", "Permission"), (GPL, "GPL header", "This program")):
        found = [x for x in licenses.notices(before + text + "\n\nOther text.") if x[2] != "unknown"]
        assert [(x[2], x[5], x[0]) for x in found] == [(name, 1.0, before.count("\n"))] or before.startswith("C") and [(x[2], x[5]) for x in found] == [(name, 1.0)]
        assert start in found[0][8]


def test_two_licenses_in_one_block():
    found = [x for x in licenses.notices("Released under the MIT License.\nLicensed under CC BY-NC 4.0.\n" + MIT) if x[2] != "unknown"]
    assert [x[2] for x in found] == ["MIT", "CC-BY-NC", "MIT text"] and [x[0] for x in found] == [0, 1, 2]


def test_rows(spark, odd_documents):
    assert licenses.scan(odd_documents).count() == 0 and licenses.scan(odd_documents.limit(0)).count() == 0
    more = odd_documents.selectExpr("doc_id", "concat(text, '\nReleased under the MIT License.') as text", "1 as license", "2 as __text").where("doc_id in (2, 5, 6)")
    rows = licenses.scan(more).collect()
    assert sorted((r.doc_id, r.license) for r in rows) == [(2, "MIT"), (5, "MIT"), (5, "MIT"), (6, "MIT")]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    family = {"CC BY-NC": "CC-BY-NC", "GNU General": "GPL", "Apache": "Apache-2.0", "MIT": "MIT"}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for k, line in enumerate(r.text.split("\n")):
            want |= {(r.doc_id, name) for key, name in family.items() if re.search(rf"(?:licensed under|released under) (?:the )?{key}", line, re.I)}
    rows = op6_license_scan(spark, sf).collect()
    assert want and want == {(r.doc_id, r.license) for r in rows if r.license != "unknown"}
    assert {r.notice for r in rows if r.license == "unknown"} <= {"All rights reserved."}
