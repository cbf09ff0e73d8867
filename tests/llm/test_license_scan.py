import os
import re

import pytest

from siftline.llm.license_scan import BSD_3, ISC, MIT, known_digests, scan


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as d", "2 as license", "3 as digest")
    return sorted((tuple(r) for r in scan(frame, **options).drop("digest").collect()), key=repr)


def test_variants_of_one_text(spark):
    mit = "Copyright (c) 2020 Some One\n\n" + MIT.replace('"', "“").replace(". ", ".\n   ").upper()
    isc = "ISC Licence\n\n(c) 1999 X\nAll rights reserved\n" + ISC.replace(",", " ,")
    rows = [(1, MIT), (2, mit), (3, isc), (4, BSD_3 + "\n"), (5, MIT + " and more"), (6, MIT[:-20]), (7, None), (8, ""), (9, " \n!!"), (None, MIT), (1, MIT)]
    got = {(d, lic) for d, lic, *_ in run(spark, rows)}
    assert got == {(1, "MIT"), (2, "MIT"), (3, "ISC"), (4, "BSD-3-Clause"), (5, None), (6, None), (7, None), (8, None), (9, None), (None, "MIT")}
    assert len(run(spark, rows)) == len(rows)


def test_notices(spark):
    rows = [
        (1, "some text\nLicenced under the Apache Licence, version 2.0\nmore\nReleased under the MIT License.\nReleased under the MIT license"),
        (2, "it is not Licensed under the Apache License, Version 2.0. today"),
        (3, "Licensed under CC BY-NC 4.0."),
        (4, "filler\n" * 20_000 + "* Licensed under CC BY-NC 4.0"),
    ]
    assert run(spark, rows + rows[:1]) == [(1, None, 3, "Apache-2.0,MIT")] * 2 + [(2, None, 0, ""), (3, "CC-BY-NC-4.0", 1, "CC-BY-NC-4.0"), (4, None, 1, "CC-BY-NC-4.0")]


def test_spellings_side_by_side(spark):
    known = known_digests(spark, [("X", "license license organization while")])
    assert run(spark, [(1, "Licence LICENCE; organisation - whilst")], known=known) == [(1, "X", 1, "X")]


def test_empty(spark):
    assert run(spark, []) == []


def test_only_claims_of_copyright_are_stripped(spark):
    from siftline.llm.license_scan import BSD_2

    wrap = lambda text, word: text.replace(f" {word}", f"\n{word}")
    claims = ["Copyright (c) 2020 Some One", "Copyright 1999-2004, X", "(c) 2001 X", "© Some One", "(c) Some One", "Copyright: Some One <a@b.c>", "Copyright (c) Some One. All rights reserved."]
    rows = [(i, claim + "\n\n" + wrap(ISC, "copyright")) for i, claim in enumerate(claims)]
    rows += [(10, wrap(MIT, "copyright")), (11, wrap(MIT, "COPYRIGHT")), (12, wrap(wrap(BSD_3, "COPYRIGHT"), "copyright")), (13, wrap(BSD_2, "copyright"))]
    assert {d: lic for d, lic, *_ in run(spark, rows)} == {**dict.fromkeys(range(7), "ISC"), 10: "MIT", 11: "MIT", 12: "BSD-3-Clause", 13: "BSD-2-Clause"}
    one = "Copyright 2024 X. Licensed under the Apache License, Version 2.0."
    assert run(spark, [(1, one), (2, "text\n" + one)]) == [(1, "Apache-2.0", 1, "Apache-2.0"), (2, None, 1, "Apache-2.0")]


TEXTS = "/usr/share/common-licenses"
NAMES = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "Artistic": "Artistic-1.0"}


@pytest.mark.skipif(not os.path.isdir(TEXTS), reason="no folder of public license texts")
def test_whole_texts_of_public_licenses(spark):
    rows, want = [], {}
    for i, (file, name) in enumerate(NAMES.items()):
        text = open(f"{TEXTS}/{file}", encoding="utf-8").read()
        end = "END OF TERMS AND CONDITIONS"
        forms = [text, text.upper(), re.sub(r"(?m)^(\s*)Copyright \(C\) [0-9, ]+", r"\1Copyright (C) 2031 ", text), re.sub(r"\blicense\b", "licence", text.replace(",", " ;")), "\n\n  " + text.replace("\n", "\n   ")]
        forms += [text[: text.index(end) + len(end)]] if end in text else []
        for form in forms:
            want[len(rows)] = name
            rows.append((len(rows), form))
        rows.append((len(rows), text[: len(text) // 2]))
    got = {d: lic for d, lic, *_ in run(spark, rows)}
    assert got == {d: want.get(d) for d, _ in rows}
