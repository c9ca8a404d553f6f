"""The stages one by one against brute force."""

import random
from collections import Counter

import corpus_pipeline
from arterial.llm import language_id

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    known = {r.doc_id: r.text for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "mix_sources"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "mix_sources":
            break
        assert out.columns == columns
        got = {r.doc_id: r.text for r in out.collect()}
        if name == "language_id":
            assert got == {d: t for d, t in known.items() if t and language_id._LETTER.search(t)}
        elif name == "line_dedup":
            kept = brute.lines([(d, t) for d, t in known.items() if t is not None])
            assert got == {d: kept[d, t] for d, t in known.items() if t is None or kept[d, t] == t or brute.words(kept[d, t])}
        elif name == "jaccard_join":
            classes = brute.jaccard(list(known.items()))
            assert got == {d: t for d, t in known.items() if classes[d][1] == d}
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaks = brute.leaks(list(known.items()), items)
            assert got == {d: t for d, t in known.items() if not leaks[d]}
        docs, known = out, got
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(brute.words(r.text))
    want = brute.targets(dict(sizes))
    rows = out.collect()
    assert {r.doc_id for r in rows} == set(known)
    assert {r.source: round(r.target, 6) for r in rows} == {s: round(x, 6) for s, x in want.items()}


def test_run_agrees_with_itself(spark):
    first = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert first == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) and first


ODD = "doc_id long, text string, lang string, source string, n_chars long, leaks string, n_lines string, n long, component_id string, size string"


def odd_documents():
    """Nulls, empty and very long texts, repeated rows and equal ids, as columns of documents and others of inner names."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    line = lambda k: " ".join(word() for _ in range(k))
    rows = [(i, "\n".join(line(12) for _ in range(6)), "aa" if i % 2 else None, f"s{i % 3}" if i % 5 else None) for i in range(40)]
    block = "\n".join(line(15) for _ in range(4))
    rows += [(100 + i, f"{line(9)}\n{block}\n{line(8)}", "aa", "s1") for i in range(5)]
    rows += [(None, rows[3][1], "aa", None), (None, line(30), None, "s2"), rows[4], rows[4], (5, line(25), "aa", "s0")]
    rows += [(200, None, None, None), (201, "", "aa", "s1"), (202, " \n\t", "aa", "s1"), (203, "12 34", "aa", "s1"), (204, line(40000), "aa", "s2"), (205, "x", None, "s0")]
    return [(*r, None if r[1] is None else len(r[1]), "l", "m", 7, "c", "z") for r in rows]


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(odd_documents(), ODD)
    known = [tuple(r) for r in docs.collect()]
    rest = lambda rows: Counter((r[0], *r[2:]) for r in rows)
    for table in (docs, docs.limit(0)):
        own = table
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, own, SF).write.parquet(str(tmp_path / f"{name}-{table is docs}"))
            out = spark.read.parquet(str(tmp_path / f"{name}-{table is docs}"))
            if name == "mix_sources":
                assert out.count() == own.count()
                break
            assert out.columns == own.columns
            got = [tuple(r) for r in out.collect()]
            assert not rest(got) - rest(known)  # rows lose text at most
            if table is docs and name == "language_id":
                assert Counter(got) == Counter(r for r in known if r[1] and language_id._LETTER.search(r[1]))
            if table is docs and name == "line_dedup":
                wanted = brute.lines([((1 << 63) - 1 if d is None else d, t) for d, t, *_ in before])
                kept = [wanted[(1 << 63) - 1 if d is None else d, t] for d, t, *_ in before]
                assert Counter(r[1] for r in got) == Counter(k for (_, t, *_), k in zip(before, kept, strict=True) if k == t or brute.words(k))
            if table is docs and name == "jaccard_join":
                ids = Counter(r[0] for r in before)
                assert {d for d in ids if d is None or d == 5 or d == 4} <= {r[0] for r in got}
            before, own = got, out
