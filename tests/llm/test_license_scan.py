import random
import re

from factloom.llm import license_scan
from factloom.llm.license_scan import TEMPLATES, TOLERANCE


def fold(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def least_edits(template, words):
    """Edits between the template and the words that suit it best, one cell at a time."""
    row = [0] * (len(words) + 1)
    for i, t in enumerate(template, 1):
        new = [i]
        for j, w in enumerate(words, 1):
            new.append(min(row[j - 1] + (t != w), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def noise(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta under the of software in any rights work license is".split()) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_every_template_is_found_with_few_differences(spark):
    rng, texts, names = random.Random(5), [], []
    for name, text in TEMPLATES:
        words = text.split()
        for edits in {0, min(3, len(fold(text)) // TOLERANCE)}:
            altered = list(words)
            plain = [i for i, w in enumerate(words) if re.fullmatch("[A-Za-z]+", w)]
            for i in rng.sample(plain, edits):
                altered[i] = "zebra"
            texts.append(noise(rng, 150) + "\n# " + "\n# ".join(altered) + "\n" + noise(rng, 40))
            names.append((name, edits))
    got = {r.doc_id: r.found for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    for i, (name, edits) in enumerate(names):
        main = [f for f in got[i] if f.license == name]
        assert len(main) >= 1, (name, edits)
        if edits:
            assert len(main[0].differences) == 2 * edits
        raw = texts[i].encode()
        for f in got[i]:
            own = [fold(t) for n, t in TEMPLATES if n == f.license]
            assert any(len(f.differences) <= 2 * (len(t) // TOLERANCE) and least_edits(t, fold(raw[f.start : f.end].decode())) <= len(t) // TOLERANCE for t in own)


def test_documents_have_what_is_written_in_them(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: [f.license for f in r.found] for r in license_scan.scan_licenses(docs).collect()}
    exact = [(n, " ".join(fold(t))) for n, t in TEMPLATES]
    some = 0
    for i, text in rows:
        joined = " " + " ".join(fold(text)) + " "
        want = {n for n, t in exact if f" {t} " in joined}
        assert set(got[i]) == want
        some += bool(want)
    assert some


def test_many_in_a_row_and_versions(spark):
    many = "Released under the MIT License. Licensed under CC BY-NC 4.0.\n" * 400
    texts = [many, "licensed under the GNU General Public License, version 4.", "Licensed under the Apache License, Version 2.0. and then Released under the MIT License.", "licensed under the moon"]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert [f.license for f in got[0].found] == ["MIT", "CC-BY-NC-4.0"] * 400
    assert all(a.end <= b.start for a, b in zip(got[0].found, got[0].found[1:]))
    assert not got[1].found and not got[3].found
    assert [f.license for f in got[2].found] == ["Apache-2.0", "MIT"]


def test_rank_is_by_size_reduction(spark):
    own = [("a", "one two three four five six seven eight nine ten"), ("b", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")]
    text = "so it says: one two three four five six seven eight nine ten eleven twelve thirteen fourteen, as before"
    (row,) = license_scan.scan_licenses(frame(spark, [text]), own).collect()
    assert [f.license for f in row.found] == ["b"] and row.found[0].differences == [] and 0 < row.found[0].reduction < 1
    assert text.encode()[row.found[0].start : row.found[0].end].decode() == "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_edges(spark, edge_docs, no_docs):
    rows = license_scan.scan_licenses(edge_docs).collect()
    assert len(rows) == edge_docs.count() and not any(r.found for r in rows)
    assert license_scan.scan_licenses(no_docs).count() == 0
    assert all(r.found == [] for r in license_scan.scan_licenses(edge_docs, []).collect())
    long = "é " * 20000 + "Released under the MIT License. " + "ü " * 20000
    (row,) = license_scan.scan_licenses(frame(spark, [long])).collect()
    assert long.encode()[row.found[0].start : row.found[0].end].decode() == "Released under the MIT License"


def test_only_version_numbers_refute(spark):
    bsd2, bsd3 = (next(t for n, t in TEMPLATES if n == name) for name in ("BSD-2-Clause", "BSD-3-Clause"))
    gnu = next(t for n, t in TEMPLATES if n == "GPL-3.0-or-later")
    bullets = lambda t, marks: re.sub(r"\b([123])\. (?=[RN])", lambda m: marks[int(m[1]) - 1] + " ", t)
    texts = [bullets(t, marks) for t in (bsd2, bsd3) for marks in ("***", ("(a)", "(b)", "(c)"), ("1)", "2)", "4)"))]
    texts += [bsd2.replace("source code", "source code 2024"), gnu.replace("version 3", "version 4"), gnu.replace("version 3", "version 3.1"), gnu.replace("version 3", "version")]
    texts += [gnu.replace("version 3", "version 4") + " and " + gnu.replace("either", "or")]
    got = {r.doc_id: r.found for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert [[f.license for f in got[i]] for i in range(7)] == [["BSD-2-Clause"]] * 3 + [["BSD-3-Clause"]] * 3 + [["BSD-2-Clause"]]
    assert got[0][0].differences == ["-1", "-2"]
    assert not got[7] and not got[8] and not got[9]
    assert [f.license for f in got[10]] == ["GPL-3.0-or-later"] and got[10][0].start > len(gnu)


def test_second_place_of_a_refuted_template(spark):
    own = [("x", "one two three version 2 four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen")]
    text = own[0][1].replace("2", "3") + " and " + own[0][1].replace("seven eight", "zebra zebra")
    (row,) = license_scan.scan_licenses(frame(spark, [text]), own).collect()
    assert [f.license for f in row.found] == ["x"] and "zebra" in text[row.found[0].start : row.found[0].end]


def test_whole_texts_of_a_folder(spark, tmp_path):
    """A long license in a file is found in a document as its parts, one after another; the listed beginnings as well."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}term" for a in "abcdefghijklmnopqr" for b in "abcdefghijklmnopqr"]
    long = " ".join(rng.choice(vocabulary) for _ in range(1100))
    (tmp_path / "Long-1.0.txt").write_text(long)
    own = license_scan.folder_templates(str(tmp_path), 250)
    assert [n for n, _ in own] == ["Long-1.0"] * 5
    changed = long.split()
    for i in range(7, 1100, 90):
        changed[i] = "zebra"
    text = noise(rng, 60) + "\n" + " ".join(changed) + "\n" + noise(rng, 60)
    (row,) = license_scan.scan_licenses(frame(spark, [text]), own).collect()
    assert len(row.found) == 5 and row.found[0].start < row.found[-1].start and row.found[-1].end - row.found[0].start > 0.98 * len(" ".join(changed))


def test_beginnings_of_long_licenses(spark):
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Artistic-1.0", "CC0-1.0", "Zlib", "ISC", "0BSD", "BSL-1.0", "Unlicense", "WTFPL"]
    longest = {n: max((t for m, t in TEMPLATES if m == n), key=len) for n in names}
    rng = random.Random(9)
    texts = [noise(rng, 30) + "\n * " + t.replace(". ", ".\n * ") + "\n" + noise(rng, 30) for t in longest.values()]
    got = {r.doc_id: [f.license for f in r.found] for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    assert [got[i][0] if got[i] else None for i in range(len(names))] == names
