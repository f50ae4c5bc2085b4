"""License scan against a plain search for phrases and texts with known edits."""

import random
import re

import pytest

from driftline.llm import licenses

rng = random.Random(9)
TEXTS = {t.label: t.words for t in licenses.TEXTS if len(t.words.split()) > 18}


def words(text):
    upper = {c: c + 32 for c in range(65, 91)}
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(upper))


def noise(n):
    return " ".join(rng.choice(["mit", "license", "apache", "general", "public", "the", "of", "foo", "3", "é"]) for _ in range(n))


def plain(text):
    own, found = words(text), []
    for t in licenses.PHRASES:
        w = t.words.split()
        found += [(i, t.label) for i in range(len(own) - len(w) + 1) if own[i : i + len(w)] == w]
    starts = [i for i, _ in found]
    return len(own), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in found}))


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, row int, spans string, template string").repartition(4)


def reported(spark, rows):
    return [(r.doc_id, *r[1:]) for r in licenses.report(licenses.scan(table(spark, rows))).collect()]


def test_phrases(spark):
    rows = [(i, noise(rng.randint(0, 80))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "The MIT-License;Apache\tLICENSE, GNU General\nPublic License"), (303, "mit"), (303, "mit license"), (304, "mit license " * 40_000), (None, "mit license"), (305, "Mİt license mit licenſe"), (306, "license mit")]
    rows += rows[190:]  # repeated rows, one by one
    got = reported(spark, rows)
    assert len(got) == len(rows)
    expected = sorted(((i, *plain(t)) for i, t in rows), key=str)
    assert sorted((g[:6] for g in got), key=str) == expected
    assert all((score == 1.0) == (n > 0) or labels for _, _, n, _, _, _, labels, score in got)


@pytest.mark.parametrize("label", sorted(TEXTS))
def test_texts_with_edits(spark, label):
    own = TEXTS[label].split()
    put_in, left_out, changed = own[:7] + ["uh", "oh"] + own[7:], own[:5] + own[6:], own[:9] + ["XX"] + own[10:]
    half = own[: len(own) // 2]
    rows = [(i, f"{noise(10)} {' '.join(w).upper()}. {noise(10)}") for i, w in enumerate((own, put_in, left_out, changed, half))]
    scanned = {r.doc_id: [s for s in r.spans if not s.phrase] for r in licenses.scan(table(spark, rows)).collect()}
    for i, length in enumerate((len(own), len(own) + 2, len(own) - 1, len(own))):
        mine = [s for s in scanned[i] if s.label == label and s.coverage >= 0.75]
        assert mine and (mine[0].start, mine[0].end) == (10, 10 + length), i
    assert not [s for s in scanned[4] if s.label == label]
    assert [s.coverage for s in scanned[0] if s.label == label][0] == 1.0


def test_shuffled_templates_give_the_same(spark, monkeypatch):
    rows = [(i, noise(60)) for i in range(50)]
    before = sorted(reported(spark, rows))
    monkeypatch.setattr(licenses, "TEMPLATE_GRAMS", 0)
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    assert sorted(reported(spark, rows)) == before


def test_empty_table_and_short_templates(spark):
    assert reported(spark, []) == []
    with pytest.raises(ValueError):
        licenses.template_grams(spark, (licenses.Template("x", "one"),))


def test_no_python_on_the_main_path(spark):
    plan = licenses.report(licenses.scan(table(spark, [(1, "mit license")])))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions", plan)
