"""Exact, near and passage dedup against brute force."""

import random
import re
import time

import pytest
from conftest_llm import CLASHES

from plumbline import session
from plumbline.llm import exact_dedup, minmax_dedup, substring_dedup
from plumbline.llm.queries import ORACLES, QUERIES

WORDS = [a + b for a in "bdfgklmnprst" for b in ("a", "e", "io", "un", "or")]


def words_of(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingle_set(text, n):
    w = words_of(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(rows, n, share):
    """Component of every row (by place in rows), as the smallest doc_id reachable."""
    sets = [shingle_set(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= share * (len(a) + len(b) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(rows[i][0], len(sets[i]), None if rows[i][0] is None else least[find(i)]) for i in range(len(rows))]


def varied(seed=3, groups=12, copies=9, size=60):
    r = random.Random(seed)
    rows, k = [], 0
    for _ in range(groups):
        base = [r.choice(WORDS) for _ in range(r.randint(8, size))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((k * 7 % 1009, " ".join(w)))
            k += 1
    return rows


EDGES = [(2001, None), (2002, ""), (2003, " \t\n"), (2004, "One two"), (2005, "one  TWO"), (2006, "word " * 30_000), (2006, "word " * 30_000), (None, "one two"), (2007, "x"), (2008, "É one two three"), (2008, "a quite different text of the same id")]


@pytest.mark.parametrize(("n", "share"), [(3, 85), (5, 80), (1, 50)])
def test_near_duplicates_are_the_brute_force_ones(docs_of, n, share):
    rows = varied() + EDGES
    got = minmax_dedup.near_duplicates(docs_of(rows, CLASHES), shingle=n, share=share)
    found = sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got.collect())))
    assert found == sorted(map(str, brute_components(rows, n, share)))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got.collect())


def test_crowded_buckets_use_blocks_and_lose_nothing(docs_of, monkeypatch):
    monkeypatch.setattr(minmax_dedup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(minmax_dedup, "BLOCK", 5)
    r = random.Random(11)
    base = [r.choice(WORDS) for _ in range(40)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(40)] = r.choice(WORDS)
        rows.append((k, " ".join(w)))
    got = minmax_dedup.near_duplicates(docs_of(rows), shingle=3, share=75)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == sorted(brute_components(rows, 3, 75))


def test_drop_near_duplicates_keeps_rows_and_columns(docs_of):
    rows = varied(groups=4) + EDGES
    docs = docs_of(rows, ["bucket", "comp"])
    out = minmax_dedup.drop_near_duplicates(docs, shingle=3, share=85)
    assert out.columns == docs.columns
    want = [(d, t) for (d, t), (_, _, c) in zip(rows, brute_components(rows, 3, 85), strict=True) if d is None or d == c]
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, want))


def test_empty_documents(docs_of):
    docs = docs_of([(1, "x")]).where("false")
    assert minmax_dedup.near_duplicates(docs).count() == exact_dedup.exact_duplicates(docs).count() == substring_dedup.repeated_spans(docs).count() == 0


def test_signature_holds_both_extremes():
    import numpy as np

    keys = minmax_dedup.permutation_keys(8)
    h = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = minmax_dedup.signature(h, keys)
    one = np.array([minmax_dedup.signature(h[i : i + 1], keys) for i in range(len(h))])
    assert (s[::2] == one[:, ::2].min(axis=0)).all() and (s[1::2] == one[:, 1::2].max(axis=0)).all()


@pytest.mark.parametrize("bits", [1 << 28, 1])
def test_exact_duplicates(docs_of, bits):
    rows = [(5, "a b"), (3, "a  b"), (9, "a\tb"), (1, "A b"), (2, None), (4, ""), (6, " "), (3, "a  b"), (None, "a b"), (7, "z" * 200_000), (8, "z" * 200_000)]
    got = exact_dedup.exact_duplicates(docs_of(rows, CLASHES), filter_bits=bits).collect()
    by = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got)
    want = [("5", "3", 5, False), ("3", "3", 5, True), ("3", "3", 5, True), ("9", "3", 5, False), ("None", "3", 5, False), ("1", "1", 1, True), ("2", "2", 2, True), ("4", "2", 2, False), ("6", "6", 1, True), ("7", "7", 2, True), ("8", "7", 2, False)]
    assert by == sorted(want)
    assert exact_dedup.drop_exact_duplicates(docs_of(rows)).count() == 6


def test_exact_duplicates_sql(spark, sf_dir):
    from comparison import oracle_rows, rows_of

    df = QUERIES["op5_bloom_exact_dedup"](spark, sf_dir)
    assert rows_of(df, sorted(df.columns)) == oracle_rows(sf_dir, ORACLES["op5_bloom_exact_dedup"], sorted(df.columns))


def brute_units(text, unit, min_words):
    text = text or ""
    if unit == "line":
        parts = [(m.start(), m.group()) for m in re.finditer(r"[^\n]+", text)]
    else:
        parts = [(m.start(), m.group()) for m in re.finditer(r"(?:[^\n]|\n(?!\n))+", text)]
    out = []
    for at, p in parts:
        w = words_of(p)
        if len(w) >= min_words:
            spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", p)]
            out.append((at + spans[0][0], at + spans[-1][1], " ".join(w)))
    return out


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_repeated_lines_and_paragraphs(docs_of, unit):
    r = random.Random(2)
    pool = [" ".join(r.choice(WORDS) for _ in range(r.randint(2, 6))) for _ in range(12)]
    rows = [(k, ("\n" if k % 2 else "\n\n").join(r.choice(pool) for _ in range(6))) for k in range(25)] + [(90, None), (91, ""), (92, "ÄÖ " + pool[0].upper() + "\n" + pool[0].upper())]
    seen, want = {}, []
    for d, t in sorted(rows):
        for a, b, w in brute_units(t, unit, 3):
            if w in seen:
                want.append((d, a, b))
            else:
                seen[w] = d
    cover = lambda spans: {(d, i) for d, a, b in spans for i in range(a, b)}
    got = [(x.doc_id, x.start, x.end) for x in substring_dedup.repeated_spans(docs_of(rows, CLASHES), unit, 3).collect()]
    assert cover(got) == cover(want)


def test_long_passages_inside_lines_are_found_and_clean_documents_left_alone(docs_of):
    r = random.Random(8)
    fresh = lambda n: " ".join(r.choice(WORDS) + r.choice(WORDS) + str(r.randrange(10**6)) for _ in range(n))
    passage = fresh(60)
    rows = [(1, fresh(30) + " " + passage + " " + fresh(10)), (2, fresh(5) + " " + passage + "\n" + fresh(40)), (3, passage), (4, fresh(200)), (5, fresh(15)), (6, "é " + fresh(70))]
    docs = docs_of(rows, ["start", "end", "digest"])
    got = substring_dedup.repeated_spans(docs).collect()
    assert {x.doc_id for x in got} == {2, 3}
    text = dict(rows)
    for x in got:
        assert text[x.doc_id][x.start : x.end] in passage and x.end - x.start > len(passage) * 0.5 and x.keep_doc_ids == [1]
    cut = {x.doc_id: x for x in substring_dedup.remove_repeats(docs).collect()}
    assert len(cut) == 6 and all(cut[k].text == text[k] and not cut[k].removed for k in (1, 4, 5, 6))
    for x in got:
        whole = text[x.doc_id]
        assert cut[x.doc_id].text == whole[: x.start] + whole[x.end :] and (cut[x.doc_id].removed[0].start, cut[x.doc_id].removed[0].end) == (x.start, x.end)


def test_short_lines_and_pasted_passages_are_both_found(docs_of, spark, tmp_path):
    r = random.Random(9)
    fresh = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(10**6)) for _ in range(n))
    line, long, passage = "Share this Page", fresh(12), fresh(60)
    rows = [(1, f"{fresh(30)}\n{line}\n{fresh(40)} {passage} {fresh(9)}\n{long}"), (2, f"{line}\n{fresh(8)}\n{long}\n{fresh(30)}"), (3, f"{fresh(25)} {passage} {fresh(25)}\nshare  THIS page"), (4, f"{fresh(50)}\n{fresh(2)}")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    text, found = dict(rows), {}
    for x in QUERIES["op1_substring_dedup"](spark, str(tmp_path)).collect():
        found.setdefault(x.doc_id, []).append(text[x.doc_id][x.start : x.end])
    assert sorted(found) == [2, 3] and sorted(found[2]) == sorted([line, long])
    assert any(x in passage and len(x.split()) >= 20 for x in found[3]) and "share  THIS page" in found[3]


def test_files_of_ended_steps_leave_the_disk(docs_of, spark):
    """Neither the table of all units nor shuffle files of steps before the last stay until the result is read."""
    left = lambda: {p for p in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in p}
    passage = " ".join(WORDS[:50])
    docs, before = docs_of([(k, f"{k} {passage} {k}\n{passage}") for k in range(40)]), left()
    written = len(session._WRITTEN)
    found = substring_dedup.repeated_spans(docs, "all")
    names = [path.rsplit("/", 1)[1] for _, path in session._WRITTEN[written:]]
    until = time.monotonic() + 20
    while left() - before and time.monotonic() < until:  # executors remove them on their own
        time.sleep(0.2)
    assert "units" not in names and "around" in names and not left() - before
    assert found.count() == 79  # twice in each document; the first one stays


@pytest.mark.parametrize("size", [31, 32, 40, 60])
def test_passages_that_repeat_are_removed_whole(docs_of, size):
    r = random.Random(size)
    fresh = lambda n: [r.choice(WORDS) + str(r.randrange(10**6)) for _ in range(n)]
    rows, want = [], {}
    for k in range(40):  # the third document has part of the passage only, and comes first in half of the cases
        passage = fresh(size)
        parts = [passage, passage, passage[size // 3 :] if k % 2 else passage[: -(size // 3)]]
        for d, p in zip((3 * k + 1, 3 * k + 2, 3 * k + 3) if k % 4 < 2 else (3 * k + 2, 3 * k + 3, 3 * k + 1), parts, strict=True):
            before, after = fresh(r.randint(0, 30)), fresh(r.randint(0, 30))
            rows.append((d, " ".join(before + p + after)))
            if p is passage and d != min(3 * k + 1 + (k % 4 >= 2), d):
                at = len(" ".join(before)) + bool(before)
                want[d] = (at, at + len(" ".join(p)))
    cover = {}
    for x in substring_dedup.repeated_spans(docs_of(rows, CLASHES)).collect():
        cover.setdefault(x.doc_id, []).append((x.start, x.end))
    assert len(want) == 40 and {d: cover.get(d) for d in want} == {d: [x] for d, x in want.items()}


def test_repeats_within_a_document_and_repeated_rows(docs_of):
    line = " ".join(WORDS[:25])
    rows = [(7, f"{line}\n{line}"), (7, f"{line}\n{line}"), (None, line)]
    got = substring_dedup.repeated_spans(docs_of(rows), "line").collect()
    assert [(x.doc_id, x.start, x.end) for x in got] == [(7, len(line) + 1, 2 * len(line) + 1)]


def test_near_duplicates_sql(spark, sf_dir):
    from comparison import oracle_rows, rows_of

    df = QUERIES["op2_minmax_near_dedup"](spark, sf_dir)
    assert rows_of(df, sorted(df.columns)) == oracle_rows(sf_dir, ORACLES["op2_minmax_near_dedup"], sorted(df.columns))
