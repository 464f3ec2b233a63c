"""The filter audit against a plain replay in Python."""

import itertools
import re
from collections import Counter

import pytest

from corpuskit.llm import audit

LETTERS = "ABCDE"
KIND = "doc_id long, text string, lang string, part string, mask int, words string, `a.b` string"
LABELS = "doc_id long, quality int, toxic int, id string"


def plain(docs, labels):
    out, totals, lows = Counter(), Counter(), {}
    for i, text, _ in docs:
        if i is not None:
            lows[text or ""] = min(i, lows.get(text or "", i))
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    for i, text, lang in docs:
        text, part = text or "", lang or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": re.search("[#$%&*|]", text) is not None,
            "E": i is not None and lows[text] < i,
        }
        for order in itertools.permutations(LETTERS):
            gone = False
            for step, f in enumerate(order, 1):
                key = (part, "".join(order), step)
                here = fails[f] and not gone
                counts = (not gone and not fails[f], here, fails[f] and gone, fails[f] and sum(fails.values()) == 1, here and i in good, here and i in toxic)
                for name, c in zip(audit.COUNTS, counts):
                    out[(*key, name)] += c
                totals[part, f] += here
                gone = gone or fails[f]
    keys = {k[:3] for k in out}
    return sorted((*k, *(out[(*k, name)] for name in audit.COUNTS), totals[k[0], k[1][k[2] - 1]]) for k in keys)


def result(spark, docs, labels):
    rows = spark.createDataFrame([(i, t, g, "x", 7, "w", "z") for i, t, g in docs], KIND).repartition(3)
    found = audit.audit(rows, spark.createDataFrame([(*r, "x") for r in labels], LABELS))
    return sorted(tuple(r) for r in found.collect())


def test_audit(spark):
    many = " ".join(f"w{i}" for i in range(120))
    docs = [(1, many, "en"), (2, many, "fr"), (3, many, None), (3, many, ""), (None, many, "en"), (-4, "few words", "en"), (5, "few words", "en")]
    docs += [(6, None, "en"), (7, "", None), (8, " \t\n", "fr"), (9, "a a " * 60, "en"), (10, "A" * 30 + " b" * 270, "en"), (11, many + " #", "fr"), (12, many.upper(), "fr")]
    docs += [(13, " ".join(f"w{i}" for i in range(80)) + " w0" * 20, "en"), (14, " ".join(f"w{i}" for i in range(79)) + " w0" * 21, "en")]
    docs += [(15, "A" + "b" * 9, "en"), (16, "AA" + "b" * 17, "en"), (17, "𠮷" * 20 + "AB", "en"), (18, "x\x1cy\xa0z " * 100, "en"), (20, "long words " * 200_000, "en")]
    docs += [(100 + i, many, "en") for i in range(40)] + [(1, many, "en")] * 3
    labels = [(1, 1, 0), (1, 0, 1), (5, None, 1), (6, 1, None), (None, 1, 1), (110, 1, 1), (999, 1, 1)]
    assert result(spark, docs, labels) == plain(docs, labels)
    assert result(spark, docs[:3], []) == plain(docs[:3], [])


def test_no_documents(spark):
    assert result(spark, [], [(1, 1, 1)]) == []


@pytest.mark.parametrize("letters", ["A", "AB"])
def test_fewer_filters(spark, letters):
    marked = spark.createDataFrame([("p", m, False, False) for m in range(1 << len(letters))], "part string, mask int, good boolean, toxic boolean")
    found = audit.replay(marked, letters).collect()
    assert len(found) == len(list(itertools.permutations(letters))) * len(letters)
    for r in found:
        assert r.kept + sum(x.removed for x in found if x.filter_order == r.filter_order and x.step <= r.step) == 1 << len(letters)
