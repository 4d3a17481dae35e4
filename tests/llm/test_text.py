"""Language ID, secrets, token counts, token shards, pages, decontamination, mixing and the pipeline."""

import array
import io
import random
import re
import zlib

import pyarrow as pa
import pytest
from conftest_llm import CLASHES
from hypothesis import example, given, settings
from hypothesis import strategies as st

from plumbline.llm import language_id, page_diff, pfair_mix, pieces, secret_scan, spaced_seed, sstable, token_counts
from plumbline.llm.queries import ORACLES, QUERIES, TARGETS

ODD = ["", " ", "  ", "a  b", "don't  x's", "日本 語 text!", "x<|endoftext|>y", "\r\n\t z", "'ll'll 'LL", "a\x1fb", "é̀ ß ſ", "...   !!\n\n\nfoo", "1234 5678", " 's", "\n", "a\n", "a \n b", "x ", "long " * 4000, "\U0001f600 smile", "naïve café, déjà-vu."]


@pytest.fixture(scope="module")
def library(tokenizer):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


def encode(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_languages(spark, docs_of):
    stems = {"en": "the and with that from this", "de": "der und nicht eine wird schön", "fr": "les des avec pour être où", "es": "los del para con está ñu"}
    r = random.Random(4)
    rows = [(k, " ".join(r.choice(stems[x].split()) for _ in range(30)), x) for k in range(240) for x in [list(stems)[k % 4]]]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 !?", "fr"), (None, "los del para con está", "es"), (1003, "der und nicht " * 20_000, None), (5, rows[5][1], "en")]
    docs = docs_of(rows, CLASHES)
    got = language_id.identify(docs)
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= x.score <= 1 for x in found)
    by = {x.doc_id: x for x in found}
    assert [by[k].lang_pred for k in (1000, 1001, 1002, None, 1003)] == ["und", "und", "und", "es", "de"]
    assert all(by[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in by if k is not None) and not by[None].held_out
    assert sum(by[k].lang_pred == x for k, _, x in rows[:240]) >= 238
    kept = language_id.keep_determined(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_texts_of_no_learned_language_are_rejected(spark, docs_of, tmp_path):
    import corpus_pipeline as cp

    stems = {"en": "the and with that from this there where", "de": "der und nicht eine wird schön werden", "fr": "les des avec pour être où dans"}
    r = random.Random(6)
    rows = [(k, " ".join(r.choice(stems[x].split()) for _ in range(40)), x) for k in range(240) for x in [list(stems)[k % 3]]]
    clean = [(500, "With the.", None), (501, "DER UND NICHT; 12 der schön", None), (502, "les des 1999 avec", None)]
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan"
    planted = [(600, "Все люди рождаются свободными и равными", None), (601, finnish, None), (602, "人人生而自由,在尊严和权利上一律平等", None), (603, "".join(r.choice("bcdfgjkmpqvxz") for _ in range(80)), None), (604, "7 8213 99 a 1202 9987 16", None)]
    stage = dict(cp.STAGES)["language_id"]
    kept = {x.doc_id for x in stage(spark, docs_of(rows + clean + planted), str(tmp_path)).collect()}
    assert kept == {x[0] for x in rows + clean}


def test_languages_without_anything_to_learn(docs_of):
    assert [x.lang_pred for x in language_id.identify(docs_of([(0, "some text"), (2, "more", None)])).collect()] == ["und", "und"]
    assert language_id.identify(docs_of([(0, "a", "en")]).where("false")).count() == 0
    one = language_id.identify(docs_of([(0, "some text", "xx"), (3, "more", None)])).collect()
    assert {x.lang_pred for x in one} == {"xx"}


def test_nothing_to_learn_keeps_texts_and_too_many_languages_raise(docs_of):
    kept = language_id.keep_determined(docs_of([(0, "some text"), (2, "more", None), (3, "12 !"), (4, None), (6, "777", "en")])).collect()
    assert sorted(x.doc_id for x in kept) == [0, 2]
    docs = docs_of([(k, "some text", f"l{k % 3}") for k in range(30)])
    assert len(language_id.fit(docs, most_languages=3).languages) == 3
    with pytest.raises(ValueError, match="most_languages"):
        language_id.fit(docs, most_languages=2)


def test_languages_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    both = QUERIES["op3_hierarchical_language_id"](spark, sf).join(docs, "doc_id").where("held_out and lang is not null")
    assert both.where("lang_pred = lang").count() >= 0.98 * both.count()


def brute_secrets(text):
    """Base spans by the contract's own patterns."""
    out = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.A):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for no, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24)):
        out += [(m.start(), no, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[0]) >= least]
    return [x for _, _, x in sorted(out)]


SECRETS = ["password = hunter22", "é TOKEN: token: abcdefgh api-key=1234567 Api_Key='zzzzzz'", "AKIA" + "A" * 16 + " AKIA123", "x" * 10 + "0123456789abcdef" * 2, "secret==abcdef;passwd:a", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", None, "", "a" * 50_000, "api_key=\"" + "Z" * 20 + "\" 日本 token=abcdef"]


def test_secrets(docs_of):
    rows = [(k, t) for k, t in enumerate(SECRETS)] + [(0, SECRETS[0]), (None, SECRETS[1])]
    found = secret_scan.scan(docs_of(rows, CLASHES)).collect()
    got = sorted((str(x.doc_id), [f"{s.kind}:{s.start}:{s.end}" for s in x.spans if s.kind in ("assign", "access", "hex")]) for x in found)
    assert got == sorted((str(d), brute_secrets(t)) for d, t in rows)
    kinds = {s.kind for x in found for s in x.spans}
    assert {"github", "private_key"} <= kinds
    assert secret_scan.scan(docs_of(rows).where("false")).count() == 0
    clean = secret_scan.redact(docs_of(rows))
    assert all("hunter22" not in (x.text or "") for x in clean.collect()) and clean.count() == len(rows)


@settings(max_examples=200, deadline=None)
@given(st.text("pasworde_tkni=: AKI12abcdef'\"\n-BEGIN", max_size=60), st.sampled_from(["", "password=abcdefgh", "AKIA" + "Z" * 17, "xoxb-1234567890ab"]))
def test_trigram_queries_never_rule_out_a_match(noise, core):
    text = noise[:20] + core + noise[20:]
    low = text.lower()
    for rule in secret_scan.RULES:
        if re.search(rule.pattern, text):
            for choices in secret_scan.trigram_query(rule.pattern):
                assert any(all(g in low for g in grams) for grams in choices)


@pytest.mark.parametrize("name", ["op6_trigram_secret_scan"])
def test_secrets_sql(spark, sf_dir, name):
    from comparison import oracle_rows, rows_of

    df = QUERIES[name](spark, sf_dir)
    assert rows_of(df, sorted(df.columns)) == oracle_rows(sf_dir, ORACLES[name], sorted(df.columns))


def test_token_counts(docs_of, tokenizer, library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100, None), (0, ODD[0]), (None, "null id")]
    got = token_counts.token_counts(docs_of(rows, CLASHES), tokenizer, limit=10).collect()
    want = [(str(d), len((t or "").encode()), len(encode(library, t)), len(encode(library, t)) > 10) for d, t in rows]
    assert sorted((str(x.doc_id), x.n_bytes, x.n_tokens, x.over_limit) for x in got) == sorted(want)
    texts = {str(d): t or "" for d, t in rows}
    assert all(x.fits_chars == max(k for k in range(min(60, len(texts[str(x.doc_id)])) + 1) if len(encode(library, texts[str(x.doc_id)][:k])) <= 10) for x in got if len(texts[str(x.doc_id)]) <= 60)
    assert token_counts.token_counts(docs_of(rows).where("false"), tokenizer).count() == token_counts.truncate(docs_of(rows).where("false"), tokenizer, 3).count() == 0


@pytest.fixture(scope="module")
def counter(tokenizer):
    return token_counts.PrefixCounter(tokenizer)


@settings(max_examples=250, deadline=None)
@example(text="\n\n0")
@example(text="a  's'll \n \n x")
@example(text="x <|endoftext|>  's<|endoftext|><|endof <|endoftext|")
@example(text="a\x1c \x85b\u3000\u2028 !\u200b \xa0x'\u2019re")
@example(text="日本 語  text\n\n 've 'v")
@given(text=st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=30) | st.text("ab's d'll  \n1.,é", max_size=40))
def test_counts_of_all_prefixes(counter, library, text):
    assert counter.prefix_counts(text) == [len(encode(library, text[:k])) for k in range(len(text) + 1)]


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=30) | st.text("ab's d'll  \n1.,é<|>", max_size=40) | st.just("a<|endoftext|>b  c <|endoftext|>"), budget=st.integers(0, 12))
def test_longest_prefix_within_a_budget(counter, library, text, budget):
    counts = [len(encode(library, text[:k])) for k in range(len(text) + 1)]
    assert counter.count_within(text, budget) == (counts[-1], max(k for k, n in enumerate(counts) if n <= budget))


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text("ab's d'll  \n1.,é日<|>я\u3000", max_size=40) | st.sampled_from(ODD[:18]), max_size=5), budget=st.integers(0, 12))
def test_many_texts_are_counted_at_once(counter, library, texts, budget):
    totals, fits = counter.counts_within(pa.array(["before", *texts], pa.string())[1:], budget)
    counts = [[len(encode(library, t[:k])) for k in range(min(60, len(t)) + 1)] for t in texts]
    assert totals.tolist() == [len(encode(library, t)) for t in texts]
    assert fits.tolist() == [max(k for k, n in enumerate(c) if n <= budget) for c in counts]


def test_tables_of_words_that_begin_alike_share_their_beginning(tokenizer, library):
    class Counted(set):
        asked = 0

        def __contains__(self, x):
            Counted.asked += 1
            return super().__contains__(x)

    found = token_counts.PrefixCounter(tokenizer)
    found.tokens = Counted(found.tokens)
    words = [stem + a + b for stem in ("unreasonableness", "internationalise") for a in "abcdefghij" for b in "klmnopqrst"]
    for w in words:
        found.table(b" " + w.encode())
    apart, Counted.asked = Counted.asked, 0
    text = "x " + " ".join(words)
    assert found.count_within(text, 10**6) == (len(encode(library, text)), len(text))
    assert Counted.asked < apart / 3
    # what goes beyond a budget is looked for in one chunk, not in all text before it
    Counted.asked, budget = 0, len(encode(library, text)) - 1
    n, k = found.count_within(text, budget)
    assert (len(encode(library, text[:k])), k) == (budget, max(j for j in range(len(text) - 30, len(text)) if len(encode(library, text[:j])) <= budget))
    assert Counted.asked < apart / 50


@pytest.mark.parametrize("text", ["word " * 30_000, "人人生而自由在尊严和权利上一律平等" * 1000, " " * 20_000 + "x", "a" * 60_000, "\n \t" * 9000, "x<|endoftext|>" * 3000, "'re" * 20_000])
def test_hostile_texts_are_counted_in_time_that_follows_their_length(counter, library, text):
    import time

    began = time.monotonic()
    counts = counter.prefix_counts(text)
    k = counter.count_within(text, 1024)[1]
    assert time.monotonic() - began < 20
    assert len(counts) == len(text) + 1 and counts[-1] == counter.count(text) == len(encode(library, text))
    assert counts[k] <= 1024 and all(n > 1024 for n in counts[k + 1 :])
    for at in (1, 7, len(text) // 3, len(text) - 1):
        assert counts[at] == len(encode(library, text[:at]))


def test_truncation(docs_of, tokenizer, library):
    rows = [(1, "Some words, and more words; don't stop " * 3), (2, None), (3, "short"), (4, "  x  ")]
    docs = docs_of(rows, ["start"])
    out = {x.doc_id: x for x in token_counts.truncate(docs, tokenizer, 9).collect()}
    for d, t in rows:
        best = max((k for k in range(len(t or "") + 1) if len(encode(library, (t or "")[:k])) <= 9))
        assert (out[d].text or "") == (t or "")[:best] and out[d].start == "clash"
    assert out[2].text is None


def test_shards(spark, docs_of, tokenizer, library):
    r = random.Random(1)
    rows = [(k * 13 % 401 - 200, " ".join(r.choice(ODD) for _ in range(4))) for k in range(401)] + [(-5, "again"), (-5, "again"), (None, "no id"), (7, None)]
    docs = docs_of(rows, CLASHES)
    got = sstable.token_shards(docs, tokenizer, end_id=2, shards=5).orderBy("start").collect()
    assert len(got) == len(rows) and [x.doc_id for x in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    start = 0
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(encode(library, t) + [2])
    for x in got:
        ids = next(i for i in texts[x.doc_id] if zlib.crc32(array.array("I", i).tobytes()) == x.ids_crc32)
        texts[x.doc_id].remove(ids)
        assert (x.start, x.n_tokens) == (start, len(ids))
        start += len(ids)
    assert sstable.token_shards(docs.where("false"), tokenizer, shards=3).count() == 0


@settings(max_examples=400, deadline=None)
@example(texts=["a\u3000 b\xa0 c\x85 d", "x\n\ny", "\n", "\nWord\nword, don't,'s \n", "é,× ,÷.  日本 語\u2003 x", "a\x1c b\x0b c", "Привет, мир. ß'll", "<|endoftext|>", "", "a<|endoftext|> b, c"])
@given(texts=st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=30) | st.text("ab's d'll  \n\t1.,é×\xa0\u3000я日😀", max_size=40) | st.sampled_from(ODD), max_size=6))
def test_ids_are_those_of_the_library(tokenizer, library, texts):
    for at in (0, 1):  # also of a slice
        ids, bounds = pieces.encoder(tokenizer)(pa.array(["before", *texts], pa.string())[at:])
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [encode(library, t) for t in ["before", *texts][at:]]


def test_memory_of_the_encoder_is_bounded(tokenizer, library):
    import tracemalloc

    pieces.encoder.cache_clear()
    encode_all, r = pieces.encoder(tokenizer), random.Random(3)
    encode_all(pa.array(["warm up"]))
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    for _ in range(8):
        texts = pa.array([" ".join("".join(r.choices("abcdefghij", k=9)) for _ in range(20_000)), "".join(r.choices("abcdefghij", k=100_000))])
        ids, bounds = encode_all(texts)
        assert ids[: bounds[1]].tolist() == encode(library, texts[0].as_py())
    del texts, ids, bounds
    kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    # 160,000 words of 9 letters and some ids each, and 8 of 100,000: less than 100 bytes a word, where an object each takes twice that
    assert kept < 16_000_000


def test_chunks_are_forgotten_beyond_the_limit(tokenizer, library):
    found = pieces.Encoder(tokenizer)
    found.known.limit = 50
    for k in range(0, 400, 20):
        texts = [" ".join(f"w{n} x{'y' * n}" for n in range(k, k + 20)), " ".join(f"a{n}" for n in range(k, k + 70))]
        ids, bounds = found(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [encode(library, t) for t in texts]
        assert len(found.known.keys) <= 50


def test_shard_files_are_searched_and_checked():
    out = io.BytesIO()
    w = sstable.Writer(out)
    want = {}
    for k in range(0, 6000, 3):
        ids = array.array("I", [k % 50257, 70_000 if k % 2 else 5] * (k % 40)).tobytes()
        want[k - 3000] = ids
        w.add(sstable.key_of(k - 3000), sstable.pack_value(ids, k), len(ids) // 4)
    w.add(sstable.key_of(9000, 0), sstable.pack_value(b"\x01\0\0\0", 1), 1)
    w.add(sstable.key_of(9000, 1), sstable.pack_value(b"\x02\0\0\0", 2), 1)
    w.close()
    r = sstable.Reader(out)
    assert r.count == 2002 and len(r.places) > 1
    for k in range(-3000, 3000, 7):
        assert [x.tobytes() for x in r.get(k)] == ([want[k]] if k in want else [])
    assert [x.tolist() for x in r.get(9000)] == [[1], [2]] and r.get(None) == []
    assert [sstable.doc_of(k) for k, _ in r][:2000] == sorted(want)
    assert all(r.may_have(k) for k in want) and sum(r.may_have(k) for k in range(10_000, 12_000)) < 100
    damaged = bytearray(out.getvalue())
    damaged[40] ^= 255
    with pytest.raises(ValueError):
        list(sstable.Reader(io.BytesIO(bytes(damaged))))


def page(body, title="t"):
    return f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a="</p>";</script></head><body>{body}</body></html>'


def test_pages(spark):
    article = "<article><header><h1>Head &amp; more</h1></header><p>One <b>bold</b>\n text.<br>Next&nbsp;line<p>Two<ul><li>item<li>other</ul><form>Name <input></form><div class='comments'><p>reader says</p></div></article>"
    full = "Head & more\n\nOne bold text. Next line\n\nTwo\n\nitem\n\nother"
    boiler = "<div>Menu here</div><p>Common notice for all</p>"
    rows = [
        (1, "https://h.org/a/1", page(f"<nav><a>x</a></nav><div class=\"side-bar ad\">buy</div>{article}<footer>f</footer><!-- c <p>x</p> -->")),
        (2, "https://h.org/a/1", page(f"<nav><a>x</a></nav>{article}")), (3, "https://h.org/b/1", page(f"{boiler}<p>Unique one</p>")), (4, "https://h.org/b/2?x=1", page(f"{boiler}<p>Unique two</p>")),
        (5, "http://other.org/b/1", page(f"{boiler}<p>Only page here</p>")), (6, None, None), (7, "", ""), (8, "no url", "plain &lt;text&gt; only"), (9, "https://h.org/z", "<p>open <a href='x'"), (None, "https://h.org/q", page("<main>m</main>")), (1, "https://h.org/a/1", None),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, key string, rank int")
    got = {(x.page_id, x.url, x.n_chars): x.text for x in page_diff.extract(df).collect()}
    texts = [(k[0], v) for k, v in got.items()]
    assert (1, full) in texts and (2, full) in texts  # copies of an article stay articles
    assert (3, "Unique one") in texts and (4, "Unique two") in texts
    assert (5, "Menu here\n\nCommon notice for all\n\nOnly page here") in texts
    assert (6, "") in texts and (8, "plain <text> only") in texts and (None, "m") in texts and len(got) == len(rows)
    assert all(k[2] == len(v) for k, v in got.items())
    assert page_diff.extract(df.where("false")).count() == 0


def test_pages_drop_nothing_else(spark):
    body = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be and <object>an object</object>.</p><noscript><p>No script.</p></noscript><p class='social history'>Social history.</p><div class='related'><p>Share this</p><p>A related one</p></div></article>"
    rows = [(1, "https://h.org/a/1", page(body)), (2, "https://h.org/a/2", page("<article><p>Other text.</p><div class='related'><p>Share this</p></div></article>"))]
    got = {x.page_id: x.text for x in page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Let x=1 be and an object.\n\nNo script.\n\nSocial history.\n\nA related one"  # the doubtful line is decided by the other page
    assert got[2] == "Other text."


def brute_pages(rows, marks):
    """Texts by plain pairing: the pages of a host in order of path and key, one of each set of equal lines."""
    from collections import defaultdict
    from os.path import commonprefix

    hosts = defaultdict(dict)
    found = {}
    for n, (_, url, html) in enumerate(rows):
        m = re.match(r"(?:[a-z]+:)?//([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", re.match(r"[^?#]*", url or "")[0])
        found[n] = (host, path, page_diff.lines(html))
        key = tuple(x.text for x in found[n][2])
        if key:
            hosts[host][key] = min(path, hosts[host].get(key, path))
    out = []
    for n, (d, _, _) in enumerate(rows):
        host, path, lines = found[n]
        own = tuple(x.text for x in lines)
        shared = set()
        if own:
            order = sorted((p, k) for k, p in hosts[host].items())
            at = next(i for i, (_, k) in enumerate(order) if k == own)
            sides = [order[i] for i in (at - 1, at + 1) if 0 <= i < len(order)]
            if sides:
                best = max(sides, key=lambda x: len(commonprefix([order[at][0], x[0]])))
                places = page_diff.common(list(own), list(best[1]))
                shared = set(places) if len(places) < len(own) else set()
        out.append((d, page_diff.article_text(lines, shared, marks)))
    return sorted(out)


@pytest.mark.parametrize("marks", [True, False])
def test_pairing_and_texts_are_the_brute_force_ones(spark, marks):
    r = random.Random(12)
    fresh = lambda n: "".join(f"<p>{' '.join(r.choice('abcdefgh') * r.randint(1, 9) for _ in range(5))}</p>" for _ in range(n))
    rows = []
    for h in range(4):
        menu, end = f"<div>{fresh(3)}</div>", fresh(2)
        for k in range(12):
            text = fresh(r.randint(1, 4))
            body = menu + (f"<article>{text}</article>" if k % 4 == 3 else text) + end
            for _ in range(r.choice([1, 1, 1, 3])):  # copies of a page at other places of its host
                rows.append((len(rows), f"https://H{h}.org/{r.choice('abc')}/{'xy'[k % 2] * r.randint(1, 4)}{len(rows)}?q={k}", page(body)))
    rows += [(900, "https://h1.org/z", page("<p>x</p>" * 30_000)), (901, "https://h1.org/z1", page("<p>x</p><p>y</p>" * 15_000)), (902, "https://h1.org/z2", None)]
    got = page_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), marks=marks)
    assert sorted((x.page_id, x.text) for x in got.collect()) == brute_pages(rows, marks)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12), st.sampled_from([4, 1 << 20]))
def test_longest_common_subsequence(a, b, bits):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    page_diff.LCS_BITS, before = bits, page_diff.LCS_BITS
    got = page_diff.common(a, b)
    page_diff.LCS_BITS = before
    rest = iter(b)
    assert got == sorted(set(got)) and all(a[i] in rest for i in got) and len(got) == best[-1][-1]


def test_decontamination(spark, docs_of):
    r = random.Random(6)
    fresh = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    items = [fresh(40), fresh(15), fresh(4), fresh(30)]
    changed = list(items[0])
    for k in (5, 14, 22, 31):
        changed[k] = "other"
    rows = [
        (1, " ".join(fresh(30) + items[0] + fresh(9))), (2, "É " + " ".join(fresh(3) + changed)), (3, ", ".join(items[1]).upper() + "!"), (4, " ".join(fresh(80))), (5, " ".join(items[2])), (6, None), (7, ""),
        (8, " ".join(items[3][:8] + fresh(50))), (9, " ".join(items[3][4:20] + fresh(5))), (None, " ".join(items[0])), (1, " ".join(fresh(30) + items[0] + fresh(9))), (10, " ".join((fresh(10) + items[1]) * 40)),
    ]
    bench = spark.createDataFrame([(k, " ".join(w), "clash") for k, w in enumerate(items)] + [(8, None, "x"), (None, " ".join(items[0]), "x"), (9, "", "x")], "item_id long, text string, doc_id string")
    docs = docs_of(rows, CLASHES)
    for block_chars in (8_000_000, 200):
        got = spaced_seed.contaminated(docs, bench, block_chars=block_chars).collect()
        assert {(x.doc_id, x.item_id) for x in got} == {(1, 0), (2, 0), (3, 1), (5, 2), (9, 3), (None, 0), (10, 1)}
        assert [(x.n_words, x.n_same) for x in got if x.doc_id == 2] == [(40, 36)] and [x.item_word for x in got if x.doc_id == 9] == [4]
        one = next(x for x in got if x.doc_id == 3)
        assert rows[2][1][one.start : one.end] == rows[2][1][:-1]
        kept = spaced_seed.drop_contaminated(docs, bench, block_chars=block_chars)
        assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [4, 6, 7, 8]
    assert spaced_seed.contaminated(docs, bench.where("false")).count() == spaced_seed.contaminated(docs.where("false"), bench).count() == 0


def mixed_order(blocks, weights, most):
    """The source of each slot of a whole schedule; every block is placed once, in its source's order."""
    order = {}
    for k, low, high, first, per_blocks, per_slots, slots in pfair_mix.schedule(blocks, weights, most):
        for j in range(high - low):
            at = first + j // per_blocks * per_slots + slots[j % per_blocks]
            assert at not in order
            order[at] = (k, low + j)
    assert sorted(order) == list(range(sum(blocks)))
    for k, n in enumerate(blocks):
        assert [order[t][1] for t in sorted(order) if order[t][0] == k] == list(range(n))
    return [order[t][0] for t in sorted(order)]


def assert_within_a_block(order, blocks, weights):
    """While no source has run out, each block is placed inside its window and no count is a whole block off."""
    total, done = sum(weights), [0] * len(blocks)
    for t, k in enumerate(order):
        j = done[k]
        assert j * total // weights[k] <= t < -(-(j + 1) * total // weights[k])
        done[k] += 1
        assert all(abs(n * total - w * (t + 1)) < total for n, w in zip(done, weights, strict=True))
        if done[k] == blocks[k]:
            return t + 1
    return len(order)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60) | st.integers(1, 10**9), st.integers(0, 70)), min_size=1, max_size=24))
def test_schedule_stays_within_a_block_in_every_phase(sources):
    weights, blocks = [w for w, _ in sources], [n for _, n in sources]
    order = mixed_order(blocks, weights, max(1, sum(blocks)))
    at, left = 0, list(blocks)
    while any(left):
        live = [k for k, n in enumerate(left) if n]
        n = assert_within_a_block([live.index(k) for k in order[at:] if k in live][: sum(left)], [left[k] for k in live], [weights[k] for k in live])
        for k in order[at : at + n]:
            left[k] -= 1
        at += n


def test_schedule_of_a_hundred_thousand_slots():
    weights = list(pfair_mix.whole_weights({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3, "d": 1e-5, "e": 0.7}).values())
    blocks = [20_000, 20_000, 20_000, 5, 45_000]
    assert assert_within_a_block(mixed_order(blocks, weights, 1 << 20), blocks, weights) > 100_000
    assert pfair_mix.whole_weights({"a": 1, "b": 1, "c": 1}) == {"a": 1, "b": 1, "c": 1}
    equal = [40_000] * 20  # a short period, many times over
    assert assert_within_a_block(mixed_order(equal, [1 + k % 4 for k in range(20)], 64), equal, [1 + k % 4 for k in range(20)]) >= 400_000


def test_long_periods_of_many_blocks_take_larger_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(pfair_mix, "MOST_NUMBERS", 60)
    rows = [(k, "t", "en", "abc"[k % 3]) for k in range(900)]
    weights = {"a": 0.123457, "b": 0.3333333, "c": 0.71}
    got = pfair_mix.mix(docs_of(rows), weights, block=4, chunk_rows=50).collect()
    assert len(got) == len({x.position for x in got}) == 900 and len({x.slot for x in got}) <= 20
    whole = pfair_mix.whole_weights(weights)
    order = [s for _, s in sorted({(x.slot, x.source) for x in got})]
    n = {s: order.count(s) for s in "abc"}
    assert_within_a_block([list(whole).index(s) for s in order], [n[s] for s in whole], list(whole.values()))
    assert pfair_mix.mix(docs_of(rows), {"a": 1, "b": 2, "c": 1}, block=4).count() == 900


def test_no_row_of_a_table_is_lost(spark):
    docs = spark.range(60_000).selectExpr("id doc_id", "concat('src', pmod(xxhash64(id), 20)) source")
    got = pfair_mix.mix(docs, TARGETS).agg({"doc_id": "count", "position": "max"}).first()
    assert got[0] == 60_000 or got[1] == 60_000
    assert pfair_mix.mix(docs, TARGETS).select("position").distinct().count() == 60_000


def test_mix(docs_of):
    rows = [(k, "t", "en", ["a", "a", "a", "b", "c"][k % 5]) for k in range(500)] + [(1000, "t", None, None), (1001, "t", None, ""), (None, "t", None, "a"), (3, "t", None, "a")]
    got = pfair_mix.mix(docs_of(rows, CLASHES), {"a": 1, "b": 2, "c": 1}, block=4, chunk_rows=16).collect()
    assert len(got) == len(rows) and len({x.position for x in got}) == len(rows)
    slots = {}
    for x in got:
        assert slots.setdefault(x.slot, x.source or "") == (x.source or "") and x.position // 4 == x.slot
    assert sorted(slots) == list(range(len(slots)))
    weight = {"a": 3, "b": 6, "c": 3, "": 4}
    total = {s: sum(v == s for v in slots.values()) for s in weight}
    done = dict.fromkeys(weight, 0)
    for t in range(len(slots)):
        done[slots[t]] += 1
        if any(done[s] == total[s] for s in weight):
            break
        assert all(abs(done[s] - weight[s] * (t + 1) / 16) < 1 for s in weight)
    assert pfair_mix.mix(docs_of(rows).where("false")).count() == 0
    with pytest.raises(ValueError):
        pfair_mix.mix(docs_of(rows), {"a": 0})


def test_mixed_rows_come_in_order(spark, docs_of, tmp_path):
    rows = [(k, f"text {k}", "en", f"s{k % 3}") for k in range(300)]
    docs = docs_of(rows, ["position", "slot"])
    out = pfair_mix.mixed(docs, {"s0": 1, "s1": 2, "s2": 3}, block=5)
    assert out.columns == docs.columns
    out.write.parquet(str(tmp_path / "mixed"))
    back = spark.read.parquet(str(tmp_path / "mixed")).selectExpr("doc_id", "_metadata.file_name f", "_metadata.row_index i").orderBy("f", "i").collect()
    want = [x.doc_id for x in pfair_mix.mix(docs, {"s0": 1, "s1": 2, "s2": 3}, block=5).orderBy("position").collect()]
    assert [x.doc_id for x in back] == want


def test_pipeline(spark, sf_dir, library):
    """The whole pipeline against a plain version of each stage."""
    import corpus_pipeline as cp
    from test_dedup import brute_components

    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "decontamination", "mix", "tokens"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect())
    rows = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    comps = brute_components([r[:2] for r in rows], 5, 80)
    rows = [r for r, c in zip(rows, comps, strict=True) if c[2] == r[0]]
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.translate({i: i + 32 for i in range(65, 91)}))
    grams = {tuple(w[k : k + 12]) for (t,) in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect() for w in [words(t)] for k in range(len(w) - 11)}
    exact = {r[0] for r in rows if any(tuple(w[k : k + 12]) in grams for w in [words(r[1])] for k in range(len(w) - 11))}
    got = cp.run(spark, sf_dir).collect()
    ids = {x.doc_id for x in got}
    assert not ids & exact and len({r[0] for r in rows} - exact - ids) <= 2  # substitutions allow a few more
    want = {r[0]: encode(library, r[1]) + [2] for r in rows}
    start = 0
    for x in sorted(got, key=lambda x: x.doc_id):
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(want[x.doc_id]), zlib.crc32(array.array("I", want[x.doc_id]).tobytes()))
        start += x.n_tokens
    kept = docs.join(spark.createDataFrame([(i,) for i in ids], "doc_id long"), "doc_id").select(docs.columns)
    order = [r.doc_id for r in pfair_mix.mix(kept, TARGETS).orderBy("position").collect()]
    assert [x.doc_id for x in sorted(got, key=lambda x: x.position)] == order


def test_pipeline_stages_on_odd_rows(spark, docs_of, tmp_path):
    import corpus_pipeline as cp

    rows = [(1, "some words of a text here and there", "en", "src0"), (2, None, None, None), (2, "", "en", ""), (None, "a text without an id but with words", "en", "src1"), (1, "some words of a text here and there", "en", "src0"), (5, "x" * 50_000, "de", "new")]
    spark.createDataFrame([(0, "nothing to see in this item at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for data in (docs_of(rows), docs_of(rows).where("false")):
        docs = data
        for name, stage in cp.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "tokens":
                assert out.columns == data.columns
                docs = out
        assert out.count() == (4 if data.count() else 0)
