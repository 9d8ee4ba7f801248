import math
import re
import textwrap
from collections import Counter

import pytest
from kinsheet.llm import licenses, queries

FILES = "doc_id long, path string, text string, license string, words string, unit string, up string"


def unwrapped(text):
    """Line by line: comment marks go, lines of a paragraph are joined, owners stand alone."""
    out, run = [], []
    for line in text.split("\n"):
        line = re.sub(r"^[ \t]*(?:#+|//+|/?\*+/?|--+|;+|%+)[ \t]*", "", line)
        line = re.sub(r"[ \t\r]*(?:\*+/)?$", "", line)
        owner = re.match(r"(?i)[ \t]*(?:copyright|\(c\)|©)", line)
        if not line or owner:
            out += [" ".join(run), line] if owner else [" ".join(run)]
            run = []
        else:
            run.append(line)
    return "\n".join([*out, " ".join(run)])


def brute(rows, least=licenses.THRESHOLD):
    """Cosines of all units to all templates, then the nearest licence file above."""
    vocabulary = {w for ts in licenses.TEMPLATES.values() for t in ts for w in licenses.words_of(t)}
    seen = Counter(w for _, _, t in rows for w in set(licenses.words_of(t or "")) & vocabulary)
    idf = {w: math.log((1 + len(rows)) / (1 + seen[w])) + 1 for w in vocabulary}
    rare = math.log(1 + len(rows)) + 1
    templates = licenses.vectors(idf)

    def best(path, text):
        units = re.split(licenses.UNIT_END, text or "") + re.split(licenses.UNIT_END, unwrapped(text or ""))
        if path and re.search(licenses.LICENSE_FILE, path):
            units.append(text or "")
        found = []
        for unit in units:
            tf = Counter(licenses.words_of(unit))
            weight = {w: n * idf.get(w, rare) for w, n in tf.items()}
            size = math.sqrt(sum(x * x for x in weight.values())) or 1
            for name, vector in templates:
                cosine = sum(weight.get(w, 0) * x for w, x in vector.items()) / size
                if cosine >= least:
                    found.append((-round(cosine, 9), name))
        return min(found, default=None)

    own = {(i, p, t): best(p, t) for i, p, t in rows}
    given = {}
    for (_, path, _), b in own.items():
        if b and path and re.search(licenses.LICENSE_FILE, path):
            up = path[: path.rfind("/") + 1]
            given[up] = min(given.get(up, (b[0], b[1], path)), (b[0], b[1], path))
    out = []
    for i, path, text in rows:
        b = own[i, path, text]
        name, source = (b[1], None) if b else (None, None)
        if not b and path is not None:
            up = path[: path.rfind("/") + 1]
            while True:
                if up in given:
                    name, source = given[up][1], up
                    break
                if not up:
                    break
                up = up[: up.rstrip("/").rfind("/") + 1]
        out.append((i, path, b[1] if b else None, name, source))
    return sorted(out, key=str)


def found(frame):
    columns = ["doc_id", "path", "license", "effective", "inherited_from"]
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_query(spark, sf_dir, documents):
    rows = [tuple(r) for r in queries.document_paths(documents).collect()]
    assert found(queries.op10_licenses(spark, sf_dir)) == brute(rows)


def test_trees_and_odd_rows(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    rows = [
        (1, "LICENSE", "MIT License\n\n" + mit[2]),
        (2, "a/b/COPYING.txt", gpl[1]),
        (3, "a/b/c/d/file.py", "nothing here"),
        (4, "a/file.py", "code\n# " + licenses.TEMPLATES["Apache-2.0"][0] + "\nmore"),
        (5, "a/x/file.py", None),
        (6, "file", ""),
        (7, None, "Released under the MIT License."),
        (8, None, None),
        (9, "z/LICENSE", "see elsewhere"),
        (10, "z/q/r.txt", "word " * 30_000 + "\nAll rights reserved.\n" + "word " * 100),
        (11, "a/b/NOTICE", mit[0]),
        (12, "a/b/z.txt", "the of and license"),
        (13, "a/b/z.txt", "x"),
        (13, "a/b/z.txt", "x"),
        (None, "a/b/c/q.txt", "y"),
    ]
    frame = spark.createDataFrame([(*r, "l", "w", "u", "p") for r in rows], FILES)
    got = found(licenses.scan(frame))
    assert got == brute(rows)
    effective = {r[0]: r[3] for r in got}
    assert effective[3] == effective[12] and effective[5] == "MIT" and effective[4] == "Apache-2.0"
    assert licenses.scan(frame.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.7, 0.95])
def test_needed_words_lose_nothing(least):
    idf = {w: 1 + len(w) % 3 for ts in licenses.TEMPLATES.values() for t in ts for w in licenses.words_of(t)}
    templates = licenses.vectors(idf)
    needed = set(licenses.needed_words(templates, least))
    for _, vector in templates:
        rest = math.sqrt(sum(x * x for w, x in vector.items() if w not in needed))
        assert rest < least


def test_plan_is_native(spark, sf_dir):
    plan = queries.op10_licenses(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("mark", ["# ", "// ", " * ", ""])
def test_wrapped_headers(spark, mark):
    rows, expected = [], {}
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            for width in (60, 79):
                lines = [mark + line for line in textwrap.wrap(text, width)]
                head = [mark + "Copyright (c) 2020 Somebody Else and others"]
                if mark == " * ":
                    head, lines = ["/*", *head], [*lines, " */"]
                expected[len(rows)] = name
                rows.append((len(rows), f"src/{len(rows)}.c", "\n".join([*head, *lines, "", "int x;"])))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert {r["doc_id"]: r["license"] for r in got} == expected


def test_rows_of_one_path_stay_apart(spark):
    rows = [(1, "a/x.py", "Released under the MIT License."), (1, "a/x.py", "nothing"), (1, "a/x.py", None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert sorted(r["license"] or "" for r in got) == ["", "", "MIT"]
