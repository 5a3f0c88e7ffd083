import textwrap

from trialspark.llm import license_scan

LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = license_scan.scan(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.licenses == sorted(v for k, v in LINES.items() if k in texts[r.doc_id])
        assert all(x > 0 for x in r.reductions) and all(x >= license_scan.SHARE for x in r.shares)
    assert sum(bool(r.licenses) for r in got) > 5


def brute(text):
    """Every template against every place of a text, by exact words."""
    words = license_scan.words(text)
    out = set()
    for name, templates in license_scan.TEMPLATES.items():
        for t in map(license_scan.words, templates):
            out |= {name} if any(words[i : i + len(t)] == t for i in range(len(words) - len(t) + 1)) else set()
    return sorted(out)


def test_each_template_within_other_words():
    for name, templates in license_scan.TEMPLATES.items():
        for t in templates:
            block = f"some words before, {t} And a few words after it."
            assert [x for x, _, _ in license_scan.scan_text(block)[1]] == [name] == sorted(set(brute(block)) & {name})


def test_near_wordings_and_others():
    names = lambda t: [x for x, _, _ in license_scan.scan_text(t)[1]]
    assert names("RELEASED UNDER THE MIT LICENSE") == ["MIT"]
    assert names("The driver needs a license to drive. Permission was not asked.") == []
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert names("Released under the MIT License. Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0", "MIT"]
    assert names("Licensed under CC BY-SA 4.0.\n" + "word " * 50000 + "\nReleased under the MIT License.") == ["CC-BY-SA-4.0", "MIT"]


def test_statements_inside_a_line_of_many_words(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 1000").limit(20).collect()]
    other = [w for t in texts for w in t.split() if not license_scan.re.search(license_scan.CUES, w)]
    other = (other * (20000 // len(other) + 1))[:20000]
    for name, templates in license_scan.TEMPLATES.items():
        for at in (400, 10000, 19900):
            for t in templates:
                line = " ".join([*other[:at], t, *other[at:]])
                found = license_scan.scan_text(line)[1]
                assert [x for x, _, _ in found] == [name] and found[0][1] > 0


def test_many_statements_in_a_line():
    names = lambda t: [x for x, _, _ in license_scan.scan_text(t)[1]]
    first = {name: templates[0] for name, templates in license_scan.TEMPLATES.items()}
    first.pop("GPL-2.0")  # eleven of twelve words of GPL-3.0, told apart below
    assert names(" ".join(first.values())) == sorted(first) == sorted(set(brute(" ".join(first.values()))))
    line = " ".join([first["MIT"]] * 5 + [first["GPL-3.0"], first["Apache-2.0"], first["CC-BY-4.0"]])
    assert names(line) == brute(line) == ["Apache-2.0", "CC-BY-4.0", "GPL-3.0", "MIT"]
    line = " ".join([first["GPL-3.0"], license_scan.TEMPLATES["GPL-2.0"][0], first["MIT"]])
    assert names(line) == brute(line) == ["GPL-2.0", "GPL-3.0", "MIT"]


def test_wrapped_statements():
    for name, templates in license_scan.TEMPLATES.items():
        for t in templates:
            for prefix in ("", "# ", " * ", "// "):
                text = "Some file\n\n" + textwrap.fill(t, 72, initial_indent=prefix, subsequent_indent=prefix) + "\n\ncode = 1\n"
                assert [x for x, _, _ in license_scan.scan_text(text)[1]] == [name]
    far = "word\n" * 3000
    both = far.join(textwrap.fill(license_scan.TEMPLATES[x][-1], 40) for x in ("BSD-2-Clause", "BSD-3-Clause", "ISC"))
    n, found = license_scan.scan_text(both)
    assert n == 3 and [x for x, _, _ in found] == ["BSD-2-Clause", "BSD-3-Clause", "ISC"]


def test_edge_rows(make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "Released under the MIT License."), (3, "license"), (3, "license")], extra="licenses")
    got = sorted((str(r.doc_id), r.n_candidates, tuple(r.licenses)) for r in license_scan.scan(docs).collect())
    assert got == [("1", 0, ()), ("2", 0, ()), ("3", 1, ()), ("3", 1, ()), ("None", 1, ("MIT",))]
    assert license_scan.scan(docs.limit(0)).count() == 0
