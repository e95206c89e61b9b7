import os

from revisio.llm import licences


def test_forms_of_a_licence(spark):
    texts = {name: text for name, _, text in licences.KNOWN}
    mit = texts["MIT"]
    rows = [(1, mit), (2, "The MIT Licence\n\nCopyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper().replace(" ", "\n ")), (3, mit.replace("sublicense", "sub-licence").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")),
            (4, mit + " more"), (5, None), (6, ""), (7, texts["ISC"].replace("the above copyright", "the above\ncopyright")), (8, "long " * 50000), (1, mit), (None, texts["Zlib"])]
    got = sorted(((r.doc_id or 0, r.licence) for r in licences.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")).collect()), key=str)
    assert got == sorted([(0, "Zlib"), (1, "MIT"), (1, "MIT"), (2, "MIT"), (3, "MIT"), (4, None), (5, None), (6, None), (7, "ISC"), (8, None)], key=str)
    assert licences.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_known_digests_differ():
    assert len({d for d, _ in licences.known()}) == 3 * len(licences.KNOWN) + len(licences.DIGESTS)


def test_long_licences(spark):
    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(i, "# Copyright 2001 Some One\n" + open(f"{folder}/{n}").read().upper().replace("\n", "\n# ")) for i, n in enumerate(names) if os.path.exists(f"{folder}/{n}")]
    got = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame(texts + [(99, "no licence")], "doc_id long, text string")).collect()}
    assert got == {99: None} | {i: list(names.values())[i] for i, _ in texts}
