"""The pipeline on a small table, stage by stage against what each stage must do."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from matchloom.llm import pii
from matchloom.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no driver tables here")
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(spark, stage(spark, out[-1], sf), "test-stage"))
    return out


def test_columns_and_order(steps):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_decisions_take_effect(spark, sf, steps):
    docs, good, single, cut, safe, pieces = ([r.asDict() for r in s.collect()] for s in steps)
    ids = lambda rows: {r["doc_id"] for r in rows}
    assert ids(docs) > ids(good) > ids(single) == ids(cut) == ids(safe) == ids(pieces)
    assert all(len(WORD.findall(r["text"])) >= 50 for r in good)
    assert len({r["text"] for r in single}) == len(single)
    windows = {}
    for r in cut:
        w = WORD.findall(r["text"])
        assert len(w) <= len(WORD.findall(next(x["text"] for x in single if x["doc_id"] == r["doc_id"])))
        windows[r["doc_id"]] = len(w)
    assert not any(pii.base_spans(r["text"]) for r in safe if "[" not in r["text"])
    assert any("[EMAIL]" in r["text"] or "[PHONE]" in r["text"] or "[CARD]" in r["text"] for r in safe)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = {r["doc_id"] for r in docs if labels.get(r["doc_id"]) == 1 and len(WORD.findall(r["text"])) >= 50}
    assert clean <= ids(good)


def brute_components(rows):
    """For each row the rows that near copies link it with, itself included."""
    sets = []
    for r in rows:
        w = WORD.findall((r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and 100 * len(x & y) >= 75 * len(x | y):
                old, new = label[i], label[j]
                label = [new if k == old else k for k in label]
    return label


def brute_cut(rows):
    words = [WORD.findall(r["text"] or "") for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        out.append(" ".join(x for k, x in enumerate(w) if k not in gone) if gone else r["text"])
    return out


def brute_kept(rows):
    """The rules for one text at a time, with references summed from all rows."""
    import pyarrow as pa

    from matchloom.llm import quality_rules as q
    from matchloom.llm.words import Words

    sums = {}
    for r in rows:
        w = Words.of(pa.array([r["text"] or ""], pa.large_string()))
        sums[r["lang"] or ""] = sums.get(r["lang"] or "", 0) + np.hstack(q.histograms(w, w.hashes()))[0]

    def distance(text, lang, a, b):
        w = Words.of(pa.array([text], pa.large_string()))
        p, q_ = np.hstack(q.histograms(w, w.hashes()))[0][a:b], sums[lang][a:b]
        p, q_ = p / max(1, p.sum()), q_ / max(1, q_.sum())
        half = lambda x: sum(u * np.log2(u / ((u + v) / 2)) for u, v in zip(x, q_ if x is p else p, strict=True) if u > 0) / 2
        return np.sqrt(max(0.0, half(p) + half(q_)))

    out = []
    for r in rows:
        text, lang = r["text"] or "", r["lang"] or ""
        w = WORD.findall(text)
        runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        twice = {k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        base = len(w) >= 50 and 100 * len(twice) <= 50 * len(w)
        rated = sums[lang][q.N_CLASSES :].sum() >= 5000
        out.append(base and not (rated and (distance(text, lang, 0, q.N_CLASSES) > 0.31 or distance(text, lang, q.N_CLASSES, None) > 0.43)))
    return out


def key(r):
    return repr(sorted(r.items()))


def check_pieces(pieces, rows):
    from tokenizers import Tokenizer

    from matchloom.llm.wordtok import vocabulary

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for r in rows:
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"], len(ids)] += len(ids)
    assert Counter({k: n for k, n in want.items()}) == sum((Counter({(p["doc_id"], p["doc_tokens"]): p["length"]}) for p in pieces), Counter())
    at = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at.get(p["sequence_id"], 0) and len(p["ids"]) == 4 * p["length"]
        at[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n <= 4096 for n in at.values())
    if len(rows) < 1000:
        by = {}
        for p in pieces:
            by.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["ids"]))
        for r in rows:
            ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            found = b"".join(x for _, x in sorted(set(by[r["doc_id"], len(ids)])))
            assert r["doc_id"] is None or np.frombuffer(found, "<u4").tolist() == ids or len([x for x in rows if x["doc_id"] == r["doc_id"]]) > 1


def check_stages(steps):
    """Each stage's rows against brute force over the stage's own input."""
    docs, good, single, cut, safe, pieces = ([r.asDict() for r in s.collect()] for s in steps)
    assert Counter(map(key, good)) == Counter(key(r) for r, k in zip(docs, brute_kept(docs), strict=True) if k)
    label, best = brute_components(good), {}
    for r, k in zip(good, label, strict=True):
        best[k] = min(best.get(k, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    ids = lambda rows: Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    assert ids(single) == Counter(best.values()) and not Counter(map(key, single)) - Counter(map(key, good))
    new = [r | {"text": t} for r, t in zip(single, brute_cut(single), strict=True)]
    assert Counter(map(key, cut)) == Counter(map(key, new))
    m = pii.field()
    new = [r | {"text": r["text"] and pii.without_spans(r["text"], pii.found_in([r["text"]], m)[0][1])} for r in cut]
    assert Counter(map(key, safe)) == Counter(map(key, new))
    check_pieces(pieces, safe)


def test_stages_against_brute_force(steps):
    check_stages(steps)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ka long, kb string, spans string, `row` string, __ka string"


def awkward():
    r = random.Random(8)
    say = lambda k: " ".join(r.choice("the of and lorem ipsum dolor sit amet élan über niño wide road stone".split()) + str(r.randrange(90)) for _ in range(k))
    base, passage = [say(r.choice((60, 90, 200))) for _ in range(20)], say(60)
    texts = [*base, *(b + " and more" for b in base[:6]), *base[:3], *(f"{say(40)} {passage} {say(40)}" for _ in range(4)), None, "", " \n", "short one", "long" * 3000, say(5000), "x" * 70 + " " + say(70)]
    texts.append(f'{say(60)} token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" {say(20)} mail a@b.example.com')
    rows = [(i, t, r.choice(("en", None)), "s", None, 1, "x", "y", "z", "w") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, say(60), None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (3, say(80), "en", "s", 5, 1, "x", "y", "z", "w")]


def test_each_stage_on_awkward_rows(spark, sf):
    rows = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    steps = [stored(spark, rows, "awkward")]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stored(spark, stage(spark, steps[-1], sf), "awkward"))
    check_stages(steps)
    # the stages behind the first on rows that the first would not have left
    everything = [r.asDict() for r in steps[0].collect()]
    cut = corpus_pipeline.repeated_passages(spark, steps[0], sf)
    assert cut.schema == steps[0].schema
    assert Counter(key(r.asDict()) for r in cut.collect()) == Counter(key(r | {"text": t}) for r, t in zip(everything, brute_cut(everything), strict=True))
    m = pii.field()
    masked = [r.asDict() for r in corpus_pipeline.personal_data(spark, steps[0], sf).collect()]
    assert Counter(map(key, masked)) == Counter(key(r | {"text": r["text"] and pii.without_spans(r["text"], pii.found_in([r["text"]], m)[0][1])}) for r in everything)
    single = corpus_pipeline.near_duplicates(spark, steps[0], sf).collect()
    label = brute_components(everything)
    blank = lambda r: not WORD.findall(r["text"] or "")
    assert len(single) == len({k for r, k in zip(everything, label, strict=True) if not blank(r)}) + len({(r["doc_id"], r["text"]) for r in everything if blank(r)})
    check_pieces([r.asDict() for r in corpus_pipeline.packed(spark, steps[0], sf).collect()], everything)


def test_each_stage_on_an_empty_table(spark, sf):
    none = spark.createDataFrame([], SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, none, sf)
        assert out.collect() == [] and (k == 4 or out.columns == none.columns)


def test_run_is_its_stages(spark, sf, steps):
    got = corpus_pipeline.run(spark, sf).select("doc_id", "start", "length").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, steps[-1].select("doc_id", "start", "length").collect()))


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
