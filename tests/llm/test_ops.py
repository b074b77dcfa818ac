"""The training-data operators against brute force, and on odd rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.llm import decontam, licenses, ngramlm, packing, quality, simhash, suffixdedup, tokencount, topk, urlfilter
from lumenframe.llm.bpe import ByteBpe
from lumenframe.llm.components import connected_components
from lumenframe.llm.eliasfano import EliasFano
from lumenframe.llm.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Null, empty, blank, repeated and long texts, a null id, and columns with names that operators use.
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "A b c d e f g"), (4, "A b c d e f g"), (5, "a B c d e f g"), (None, "x y z"), (None, None), (6, "w" * 3000), (7, "né ü " * 200), (8, "<|endoftext|> mit  license\n\n x")]
SCHEMA = "doc_id long, text string, fp long, key string, rank int, node long, rest int, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "k", 2, 3, 4, "en") for i, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def held_out(i, n):
    return i is not None and zlib.crc32(str(i).encode()) % n == 0


# ---- 1 SimHash


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, bits=4):
    low = {}
    todo = list(range(len(rows)))
    while todo:
        group, front = [], [todo.pop()]
        while front:
            x = front.pop()
            group.append(x)
            near = [y for y in todo if (rows[x][1] ^ rows[y][1]).bit_count() <= bits]
            todo = [y for y in todo if y not in near]
            front += near
        ids = [rows[x][0] for x in group if rows[x][0] is not None]
        low.update({x: min(ids, default=None) for x in group})
    return sorted((rows[x][0] if rows[x][0] is not None else -1, f"{rows[x][1]:016x}", low[x]) for x in low)


def test_simhash(spark, odd):
    for df in (odd, documents(spark).limit(60)):
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
        assert got == brute_components(rows)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_links_of_dense_and_sparse_buckets(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(60)}
    rows = [(n, x) for n, x in enumerate(sorted(fps))]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for _, x in rows], "fp long")
    labels = {r.node % (1 << 64): r.label % (1 << 64) for r in connected_components(simhash.link_fingerprints(df)).collect()}
    groups = defaultdict(set)
    for n, x in rows:
        groups[labels.get(x, x)].add(n)
    want = defaultdict(set)
    for n, _, c in brute_components(rows):
        want[c].add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 201: 200}


def test_keep_one_of_each(spark, odd):
    kept = simhash.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == [1, 4, 6, 7, 8]  # 2 and 3 are empty like 1, 5 is 4 again


def test_keep_one_of_each_by_fingerprint(spark):
    texts = ["a b c d e f g " * 100 + f"{tail}1 {tail}2 {tail}3 {tail}4 {tail}5 {tail}6" for tail in "xy"] + ["another text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in simhash.near_copies(docs).sort("doc_id").collect()] == [0, 1, 2]  # few of the distinct shingles are common
    assert [r.component_id for r in simhash.near_duplicates(docs).sort("doc_id").collect()] == [0, 0, 2]
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == [0, 2]


# ---- 2 suffixes


def brute_removal(texts, n):
    seen = Counter(b[s : s + n] for t in texts for b in [(t or "").encode()] for s in range(len(b) - n + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if seen[b[s : s + n]] > 1:
                gone[s : s + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed, n):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefgh é") for _ in range(k))
    parts = [word(rng.randint(50, 700)) for _ in range(10)] + ["ab" * 150, "x" * 400]
    made = []
    for _ in range(40):
        made.append("".join(rng.choice(parts)[rng.randint(0, 60) :][: rng.randint(1, 700)] if rng.random() < 0.5 else word(rng.randint(0, 150)) for _ in range(3)))
    return [*made, None, "", made[0], made[1][:n], made[1][: n - 1]]


@pytest.mark.parametrize(("n", "most_single"), [(64, 1_000_000), (100, -1)])
def test_suffix_dedup(spark, n, most_single):
    texts = passages(n, n)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(df, n, most_single=most_single).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal(texts, n)


def test_suffix_dedup_odd(spark, odd):
    rows = odd.collect()
    want = sorted((r.doc_id or -1, *x) for r, x in zip(rows, brute_removal([r.text for r in rows], 64), strict=True))
    got = suffixdedup.remove_repeats(odd, 64, keep_text=True).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(r.rest.lang == "en" and hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert suffixdedup.remove_repeats(odd.limit(0), 64).count() == 0


def test_long_texts_are_worked_on_in_parts(monkeypatch):
    rng = random.Random(1)
    text = bytes(rng.randrange(97, 105) for _ in range(5000))
    whole = [c for _, c in suffixdedup.chunks([text], 64)]
    parts = list(suffixdedup.chunks([text], 64, 700))
    assert len(parts) > 3
    cover = sorted((int(a + c.offset[t]), int(b + c.offset[t])) for _, c in parts for t, a, b in zip(c.text, c.first, c.last, strict=True))
    assert [a for a, _ in cover] == [0] + [b + 1 for _, b in cover[:-1]] and cover[-1][1] == int(whole[0].last[-1])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12), max_size=12), min_size=1, max_size=5))
def test_loser_tree(runs):
    runs = [sorted(Counter(r).items()) for r in runs]
    got = list(suffixdedup.merged([suffixdedup.decoded(suffixdedup.front_coded(r)) for r in runs]))
    assert sorted((t, c) for t, _, c in got) == sorted(x for r in runs for x in r) and [t for t, _, _ in got] == sorted(t for t, _, _ in got)
    for (a, _, _), (b, shared, _) in zip(got, got[1:], strict=False):
        assert shared == len(os.path.commonprefix([a, b]))


# ---- 3 and 8 tokens


TEXTS = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", " \n", "'s", "'re", "'ll", "é", "日本", "12", ".", "!!", "\xa0", "\x1c", "\x1d\x1e", "\x1f", "\x0b", "\x85", "\u2028", "\x00", "\x7f", "<|endoftext|>", "<|", "👍", "\r\n", "ing"]), max_size=14).map("".join) | st.text(max_size=30)


@settings(max_examples=200, deadline=None)
@given(text=TEXTS)
def test_ids_and_prefix_counts(bpe, library, text):
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    assert bpe.ids(text).tolist() == ids(text)
    assert bpe.prefix_counts(text).tolist() == [len(ids(text[: i + 1])) for i in range(len(text))]


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(TEXTS, max_size=8))
def test_many_texts_at_once(bpe, library, texts):
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    assert [x.tolist() for x in bpe.ids_of(texts)] == [ids(t) for t in texts]
    assert [x.tolist() for x in bpe.prefix_counts_of(texts)] == [[len(ids(t[: i + 1])) for i in range(len(t))] for t in texts]


def test_control_characters(bpe, library):
    rng = random.Random(6)
    alphabet = [chr(c) for c in (*range(0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x200B, 0x3000, 0xFEFF)] + ["a", "1", ".", "'s"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 8))) for _ in range(20_000)] + ["\x0b\n\n\x1c", "\xa0\xa0\x1c"]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [int(c[-1]) for c in bpe.prefix_counts_of(texts)] == want
    assert [len(x) for x in bpe.ids_of(texts)] == want
    for text in texts[:1500]:
        assert bpe.prefix_counts(text).tolist() == [len(library.encode(text[: i + 1], add_special_tokens=False).ids) for i in range(len(text))]


def test_very_long_texts_and_units(bpe, library, monkeypatch):
    monkeypatch.setattr("lumenframe.llm.bpe.LONG", 50)
    monkeypatch.setattr("lumenframe.llm.bpe.REMEMBERED", 30)
    rng = random.Random(4)
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    for _ in range(20):
        text = "".join(rng.choice(["word ", "it's ", "é", " ", "\n", "12", "x" * 60, "ab ", "<|endoftext|>"]) for _ in range(120))
        assert bpe.ids(text).tolist() == ids(text) == bpe.ids_of([text, "a b"])[0].tolist()
        counts = bpe.prefix_counts(text)
        assert len(counts) == len(text) and all(counts[i] == len(ids(text[: i + 1])) for i in range(0, len(text), 7))


def test_token_counts(spark, odd, library):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(odd, 50).collect())
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((r.doc_id or -1, len((r.text or "").encode()), n(r.text), n(r.text) > 50) for r in odd.collect())
    kept = tokencount.token_prefixes(odd.where("doc_id = 7")).select(tokencount.tokens_of_prefix(5).alias("a"), tokencount.longest_within(9).alias("b")).first()
    text = ODD[9][1]
    assert kept.a == n(text[:5]) and n(text[: kept.b]) <= 9 < n(text[: kept.b + 1])
    assert tokencount.count_tokens(odd.limit(0)).count() == 0


def test_packing(spark, odd, library):
    for df in (odd, documents(spark)):
        got = packing.pack_documents(df, capacity=256, shard=100).collect()
        bins = defaultdict(list)
        pieces = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
            pieces[r.doc_id].append(r)
        for spans in bins.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) <= 256
        want = Counter()
        for r in df.collect():
            raw = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            at = k = 0
            while at < len(raw):
                n = (len(raw) - at) % 256 or 256
                want[r.doc_id, k, at, n, zlib.crc32(raw[at : at + n].tobytes())] += 1
                at, k = at + n, k + 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_packing_is_tight():
    rng = np.random.default_rng(2)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 8000).astype(np.int64) + 1)
    bins, offsets = packing.pack(lengths)
    assert np.bincount(bins, lengths).max() <= 2048
    assert bins.max() + 1 <= -(-lengths.sum() // 2048) * 1.005


# ---- 4 URLs


def test_url_rules(spark):
    urls = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x=/es/", "http://x.org", "http://b.com/fr/1", "http://b.com/de/", "http://b.net/", "nourl", None, "http://fooorg/", "a://b://c/d", "http://notexample.org/es/", "http://h.com#/fr/"]
    df = spark.createDataFrame([(n, u, None) for n, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(df).collect()}
    assert [got[n] for n in range(len(urls))] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("x.org", "", None, "allow"), ("b.com", "/fr/1", "com/fr/", "allow"), ("b.com", "/de/", "com/de/", "block"), ("b.net", "/", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("fooorg", "/", None, "allow"), ("b:", "//c/d", None, "allow"), ("notexample.org", "/es/", "org/", "allow"), ("h.com", "", None, "allow"),
    ]
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


def brute_urls(pages, rules, rounds=12):
    parsed = []
    for page, url, html in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        parsed.append((page, host, path, max(fits, key=lambda r: (len(r.text), r.text), default=None), html))
    edges = {(h, d.lower()) for _, h, _, _, html in parsed if h for d in re.findall(r'href="https?://([^/?#"]+)', html or "") if d.lower() != h}
    votes = defaultdict(int)
    for _, h, _, r, _ in parsed:
        if r and h:
            votes[h] += 1 if r.verdict == "allow" else -1

    def rank(edges, seeds):
        out, mass = defaultdict(list), {h: 0.15 / len(seeds) for h in seeds}
        for a, b in edges:
            out[a].append(b)
        for _ in range(rounds):
            new = defaultdict(float, {h: 0.15 / len(seeds) for h in seeds})
            for h, m in mass.items():
                for b in out[h]:
                    new[b] += 0.85 * m / len(out[h])
            mass = new
        return mass

    trust, distrust = rank(edges, [h for h, n in votes.items() if n > 0]), rank({(b, a) for a, b in edges}, [h for h, n in votes.items() if n < 0])
    return sorted((p or -1, h, path, r.text if r else "", r.verdict if r else "block" if distrust.get(h, 0) > trust.get(h, 0) + 1e-12 else "allow") for p, h, path, r, _ in parsed)


def test_url_verdicts(spark, monkeypatch):
    rng = random.Random(6)
    hosts = ["a.example.org", "example.org", "b.com", "X.b.com", "c.net", "d.net", "e.net", "f.net", "g.de"]
    for links in (0, 1, 3):
        pages = []
        for n in range(80):
            url = f"http://{rng.choice(hosts)}{rng.choice(['/es/1', '/en/1x', '/fr/', '/de/2?q#r', '/', ''])}"
            pages.append((rng.choice([n, None, 5]), rng.choice([url, url, url, None, "no"]), "".join(f'<a href="https://{rng.choice(hosts)}/x">' for _ in range(rng.randint(0, links)))))
        df = spark.createDataFrame([(*p, "x", "y", 1) for p in pages], "page_id long, url string, html string, host string, rule string, row int").repartition(3)
        want = brute_urls(pages, urlfilter.RULES)
        for compiled in (200, 0):
            monkeypatch.setattr(urlfilter, "COMPILED", compiled)
            got = urlfilter.filter_urls(df).collect()
            assert sorted((r.page_id or -1, r.host, r.path, r.rule or "", r.verdict) for r in got) == want
            assert links > 1 or {r.verdict for r in got if r.host == "c.net"} <= {"allow", "block"}


def test_link_graph(spark):
    pages = [(1, "http://good.org/", '<a href="http://friend.net/">'), (2, "http://bad.com/de/", ""), (3, "http://farm.net/", '<a href=//bad.com/x> <a href="https://bad.com/y">'), (4, "http://friend.net/", '<a href="/local">'), (5, "http://alone.net/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.host: r for r in urlfilter.filter_urls(df).collect()}
    assert {h: r.verdict for h, r in got.items()} == {"good.org": "allow", "bad.com": "block", "farm.net": "block", "friend.net": "allow", "alone.net": "allow"}
    edges = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "a")]
    mass = {r.host: r.mass for r in urlfilter.propagate(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("d",), ("a",)], "host string"), 12).collect()}
    want = {h: 0.075 * (h in "ad") for h in "abcd"}
    for _ in range(12):
        want = {h: 0.075 * (h in "ad") + sum(0.85 * want[u] / sum(x == u for x, _ in edges) for u, v in edges if v == h) for h in "abcd"}
    assert mass == pytest.approx(want)


def test_an_unrelated_link_changes_no_verdict(spark):
    pages = [(1, "http://bad.com/de/", ""), (2, "http://bad.com/en/", None), (3, "http://good.org/", ""), (4, "http://good.com/fr/", ""), (5, "http://good.com/en/", ""), (6, "http://alone.net/", "")]
    link = [(7, "http://one.net/", '<a href="http://two.net/">')]
    said = []
    for rows in (pages, pages + link):
        got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id < 7")
        said.append({r.page_id: (r.verdict, round(r.trust, 9), round(r.distrust, 9)) for r in got.collect()})
    assert said[0] == said[1]
    assert {i: v[0] for i, v in said[0].items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}
    assert said[0][2] == ("block", 0.0, 0.15) and said[0][5] == ("allow", 0.075, 0.0) and said[0][6] == ("allow", 0.0, 0.0)


# ---- 5 search


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(400)]
    rows += [(400, None), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [math.inf] * 6), (550, [math.nan] * 6), (None, [1.0] * 6), (600, [0.0] * 6), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for block in (64, 8192):
        assert sorted(tuple(r) for r in topk.top_k(df, block=block, least=block).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, 2.0]), (2, [-3e38, 0.0]), (3, [1e6, 1e6]), (50, [1e6, 1e6])], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(df).collect()}
    most = (1 << 63) - 1
    assert got[0, 1] == got[0, 3] == most and got[0, 2] == -most - 1 and got[50, 3] == 2 * int(256 * 1e6) ** 2


def test_top_k_with_many_equal_rows_and_clashing_names(spark):
    rows = [(n % 3 + 1, [float(n % 5), 1.0], 1, 1, 1) for n in range(300)] + [(50, [1.0, 1.0], 1, 1, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int, asks int, v int").repartition(3)
    got = topk.top_k(df, block=32, least=32).collect()
    want = sorted((-int(256 * v[0] * 256 + 256 * 256), i) for i, v, *_ in rows if i != 50)[:5]
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(50, k + 1, i, -x) for k, (x, i) in enumerate(want)]


def test_top_k_query(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    got = QUERIES["op5_exact_topk"](spark, DATA).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(ORACLE_SQL["op5_exact_topk"]).fetchall())


# ---- 6 decontamination


def test_infix_distance():
    rng = random.Random(0)
    for _ in range(150):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(0, n))) for n in (8, 14))
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
            row = new
        assert decontam.infix_distance(p, t)[0] == min(row)


def test_leaks(spark, odd):
    docs = documents(spark)
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    texts = {r.item_id: decontam.normalised(r.text) for r in items.collect()}
    host = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    rng = random.Random(3)
    rows, edited = [], {}
    for n in range(80):
        item = rng.choice(sorted(texts))
        s = list(texts[item])
        for _ in range(int(0.15 * len(s))):
            at, how = rng.randrange(len(s)), rng.random()
            s[at : at + (how < 0.67)] = rng.choice("abcdefgh ") if how > 0.33 else ""
        t = host[n % 40]
        rows.append((n, t[: len(t) // 2] + " " + "".join(s) + " " + t[len(t) // 2 :]))
        edited[n] = item
    found = {(r.doc_id, r.item_id): r for r in decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    within = [n for n, i in edited.items() if decontam.infix_distance(texts[i], decontam.normalised(rows[n][1]))[0] <= int(0.2 * len(texts[i]))]
    assert sum((n, edited[n]) in found for n in within) >= 0.9 * len(within) > 60
    for (n, i), r in found.items():
        assert r.edits == decontam.infix_distance(texts[i], decontam.normalised(rows[n][1]))[0] <= 0.2 * len(texts[i])
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if t in decontam.normalised(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()}
    assert exact and exact <= got
    assert {r.doc_id for r in decontam.drop_leaks(docs, items).select("doc_id").collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in got}
    assert decontam.find_leaks(odd, items).count() == 0 and decontam.drop_leaks(odd, items.limit(0)).count() == len(ODD)
    strange = spark.createDataFrame([(1, None), (2, ""), (None, "x y z")], "item_id long, text string")
    assert decontam.find_leaks(odd, strange).count() == 0 and decontam.find_leaks(docs.limit(0), items).count() == 0


LETTERS = st.sampled_from("abé日 ")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(LETTERS, min_size=1, max_size=90), st.text(LETTERS, max_size=150)), min_size=1, max_size=6))
def test_many_distances_at_once(pairs):
    best, end = decontam.infix_distances(*map(list, zip(*pairs, strict=True)))
    assert list(zip(best.tolist(), end.tolist(), strict=True)) == [decontam.infix_distance(p, t) for p, t in pairs]


def edited(rng, text, share):
    s = list(text)
    for _ in range(int(share * len(text))):
        at, how = rng.randrange(len(s)), rng.random()
        s[at : at + (how < 0.67)] = rng.choice("abcdefgh ") if how > 0.33 else ""
    return "".join(s)


def test_recall_by_length_and_edits():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: decontam.normalised(" ".join(rng.choice(words) for _ in range(n))[:n])
    for n, least in ((6, 1), (10, 1), (20, 1), (45, 1), (79, 1), (90, 0.75), (120, 0.85), (200, 0.9), (400, 0.9)):
        items = [decontam.Item(i, text(n)) for i in range(60)]
        finder = decontam.Finder(items, 0.8)
        for share in (0, 0.1, 0.15, 0.2):
            texts = [decontam.normalised(f"{text(200)} {edited(rng, i.text, share)} {text(200)}") for i in items]
            found = {(t, i): e for t, i, e, *_ in finder.matches(texts)}
            assert all(e == decontam.infix_distance(items[i].text, texts[t])[0] for (t, i), e in list(found.items())[:20])
            within = [k for k, i in enumerate(items) if decontam.infix_distance(i.text, texts[k])[0] <= finder.allowed[k]]
            assert sum((k, k) in found for k in within) >= (least if share == 0.2 else 1 if share == 0 else max(0.9, least * (n < 80))) * len(within), (n, share)


def test_scripts_without_spaces():
    rng = random.Random(2)
    text = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    items = [decontam.Item(i, text(90)) for i in range(10)]
    texts = [text(100) + edited(rng, i.text, share) + text(100) for share in (0, 0.1) for i in items]
    found = {(t, i) for t, i, *_ in decontam.Finder(items, 0.8).matches(texts)}
    assert all((t, t % 10) in found for t in range(20))


# ---- 7 quality


def test_quality(spark, odd):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert all(r.held_out == held_out(i, 5) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    test = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if held_out(r.doc_id, 5)]
    assert sum(a == b for a, b in test) >= 0.95 * len(test)
    strange = spark.createDataFrame([(4, None), (None, 1), (99, 0)], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(odd, strange).collect()} == {0.5}
    assert quality.quality_scores(odd, labels).count() == len(ODD) and quality.quality_scores(odd.limit(0), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


# ---- 9 licences


def test_licenses(spark, odd):
    more = spark.createDataFrame([(100020, "MIT License mit license; Apache license... General Public License the MITé license"), (100021, licenses.TEMPLATES[1][1].replace("this", "such great")), (100022, "licensed under CC BY-NC 4.0 and the")], "doc_id long, text string")
    for df in (odd.select("doc_id", "text").unionByName(more), documents(spark)):
        want = []
        for r in df.collect():
            w = licenses.template_words(r.text or "")
            places = [(i, label) for p, label in licenses.PHRASES for q in [p.split()] for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
            at = [i for i, _ in places]
            want.append((r.doc_id or -1, len(w), len(at), min(at, default=-1), max(at, default=-1), ",".join(sorted({x for _, x in places}))))
        got = licenses.scan_licenses(df).collect()
        assert sorted((r.doc_id or -1, r.n_words, r.n_base, -1 if r.first_word is None else r.first_word, -1 if r.last_word is None else r.last_word, r.base_labels) for r in got) == sorted(want)
        labels = {r.doc_id: r.labels for r in got}
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 for r in got)
        if 100021 in labels:
            assert (labels[100020], labels[100021], labels[100022]) == ("apache,gpl,mit", "mit", "cc-by-nc")
    assert licenses.scan_licenses(odd.limit(0)).count() == 0


def brute_licenses(text, k=3, slack=3, least=0.7):
    w = licenses.template_words(text or "")
    labels, score = set(), 0.0
    for label, template in licenses.TEMPLATES:
        t = licenses.template_words(template)
        held = defaultdict(set)
        for at in range(len(w) - k + 1):
            for place in range(len(t) - k + 1):
                if w[at : at + k] == t[place : place + k]:
                    held[at - place].add(place)
        for d in held:
            share = len(set().union(*(held[e] for e in range(d, d + slack + 1) if e in held))) / (len(t) - k + 1)
            if share >= least:
                labels.add(label)
                score = max(score, share)
    base = {x for p, x in licenses.PHRASES if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))}
    return ",".join(sorted(labels | base)), round(score or float(bool(base)), 9)


def test_license_spans(spark, monkeypatch):
    rng = random.Random(8)
    bsd = licenses.template_words(next(t for label, t in licenses.TEMPLATES if label == "bsd"))
    parted = " x ".join(" ".join(bsd[i : i + 3]) for i in range(len(bsd) - 2))  # every k-gram, none in its place
    texts = [parted, " ".join(bsd), " ".join(bsd) + " and " + licenses.TEMPLATES[0][1], "a " * 5000 + licenses.TEMPLATES[2][1] + " b" * 5000 + " " + licenses.TEMPLATES[5][1]]
    for _ in range(40):  # words left out, put in and changed
        words = []
        for w in licenses.template_words(rng.choice(licenses.TEMPLATES)[1]) * rng.choice([1, 1, 2]):
            words += rng.choices([[w], [], [w, "new"], ["other"]], [30, 1, 1, 1])[0]
        texts.append(" ".join(words))
    df = spark.createDataFrame([(n, t, 1, "x", "y") for n, t in enumerate(texts)], "doc_id long, text string, row int, gram string, words string").repartition(3)
    for listed in (licenses.LISTED, 0):
        monkeypatch.setattr(licenses, "LISTED", listed)
        got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan_licenses(df).collect()}
        assert got == {n: brute_licenses(t) for n, t in enumerate(texts)}
        assert got[0] == ("", 0.0) and got[1][0] == "bsd" and got[3][0] == "apache,mit"


# ---- 10 language model


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=200, unique=True), st.lists(st.integers(0, (1 << 64) - 1), max_size=20))
def test_elias_fano(values, others):
    v = np.array(sorted(values), np.uint64)
    ef = EliasFano(np.frombuffer(EliasFano.encode(v), np.uint8))
    where = {x: i for i, x in enumerate(sorted(values))}
    asked = values + others
    assert ef.find(np.array(asked, np.uint64)).tolist() == [where.get(x, -1) for x in asked]
    assert ef.all().tolist() == sorted(values)
    for x in asked[:20]:  # few values are searched by buckets
        assert ef.find(np.array([x], np.uint64)).tolist() == [where.get(x, -1)]
    for i in range(0, len(values), 7):
        assert ef.get(np.array([i])).tolist() == [sorted(values)[i]]


def test_scores(spark, odd):
    low = dict(min_word=2, min_context=2)
    for df in (odd, documents(spark)):
        rows = [(r.doc_id, (r.text or "").encode().lower().split() + [b"\n"]) for r in df.collect()]
        c = Counter(w for i, t in rows if not held_out(i, 10) for w in t)
        n, v = sum(c.values()), len(c)
        base = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
        counts = {2: Counter(), 3: Counter()}
        for i, t in rows:
            if not held_out(i, 10):
                s = [None, *t]
                for k in range(1, len(s)):
                    counts[2][tuple(s[k - 1 : k + 1])] += 1
        texts = c[b"\n"]
        grams = {g: m for g, m in counts[2].items() if m >= 2 and c[g[1]] >= 2 and (g[0] is None or c[g[0]] >= 2)}
        used = defaultdict(float)
        total = lambda ctx: texts if ctx is None else c[ctx]
        for g, m in grams.items():
            used[g[0]] += max(m - 0.6, 1e-3) / max(total(g[0]), m)

        def score(t):
            out = 0.0
            for a, b in zip([None, *t], t, strict=False):
                p = base(b)
                if a is None or c[a] >= 2:
                    own = grams.get((a, b))
                    p = (max(own - 0.6, 1e-3) / max(total(a), own) if own else 0) + max(1e-9, 1 - used[a]) * p
                out += math.log10(p)
            return out

        got = ngramlm.train_and_score(df, order=2, **low).collect()
        want = sorted((i if i is not None else -1, held_out(i, 10), len(t), sum(w in c for w in t), n, round(sum(math.log10(base(w)) for w in t), 6), round(score(t), 1)) for i, t in rows)
        mine = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in got)
        for a, b in zip(mine, want, strict=True):
            assert a[:6] == b[:6] and a[6] == pytest.approx(b[6], rel=2e-3, abs=0.06)
    assert ngramlm.train_and_score(odd.limit(0)).count() == 0


def test_context_helps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = ngramlm.train_and_score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > total[1]


def test_three_levels(spark):
    rows = list(enumerate(["a b c", "d b e", "a b c f", "b a"] * 20))
    train = [[None, *t.split(), "\n"] for i, t in rows if not held_out(i, 10)]
    grams = {k: Counter(tuple(s[j - k + 1 : j + 1]) for s in train for j in range(max(1, k - 1), len(s))) for k in (1, 2, 3)}
    n, v = sum(grams[1].values()), len(grams[1])
    grams[1][(None,)] = len(train)
    share = {k: {g: (m - 0.6) / grams[k - 1][g[:-1]] for g, m in grams[k].items() if m >= 2} for k in (2, 3)}

    def score(s):
        out = 0.0
        for j in range(1, len(s)):
            p = (grams[1][(s[j],)] + 0.1) / (n + 0.1 * (v + 1))
            for k in (2, 3):
                if j >= k - 1 and grams[k - 1][tuple(s[j - k + 1 : j])] >= 2:
                    context = tuple(s[j - k + 1 : j])
                    p = share[k].get((*context, s[j]), 0) + max(1e-9, 1 - sum(x for g, x in share[k].items() if g[:-1] == context)) * p
            out += math.log10(p)
        return out

    for r in ngramlm.train_and_score(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.score == pytest.approx(score([None, *dict(rows)[r.doc_id].split(), "\n"]), abs=0.01)


def test_texts_in_parts(spark, odd):
    for df in (odd, documents(spark)):
        rows = [sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngramlm.train_and_score(df, together=n).collect()) for n in (1 << 20, 900)]
        for a, b in zip(*rows, strict=True):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-4)


def test_scores_do_not_depend_on_chunks_or_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    some = None
    for parts, together in ((1, 8 << 20), (6, 50_000), (3, 700)):
        got = {r.doc_id: (r.n_tokens, r.n_known, r.score) for r in ngramlm.train_and_score(docs.repartition(parts), together=together).collect()}
        some = some or got
        assert {i: g[:2] for i, g in got.items()} == {i: g[:2] for i, g in some.items()}
        assert max(abs(got[i][2] - some[i][2]) / abs(some[i][2]) for i in some) < 1e-9


def test_a_context_may_be_parted_between_shards(tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    hi, lo = np.sort(rng.choice(np.array([3, 4, 9, 1 << 34], np.uint64), 4000)), rng.integers(0, 3000, 4000, np.uint64)
    run = ngramlm._summed([(hi, lo, rng.integers(2, 90, 4000))])
    told = []
    for n in (1, 2, 4, 50):
        rows = []
        for k, at in enumerate(np.array_split(np.arange(len(run[0])), n)):
            for first, word, size, _, blob in ngramlm._shards(tuple(x[at] for x in run), np.full(len(at), 1 << 18), 3001):
                rows.append((first, word, size, str(tmp_path / f"{n}-{k}-{len(rows)}")))
                with open(rows[-1][3], "wb") as out:
                    out.write(blob)
        monkeypatch.setattr(ngramlm, "_laid_out", lambda files, rows=rows: sorted(rows))
        level = ngramlm.MappedLevel(ngramlm.Level(("x",), len(run[0]), 1), 3001)
        assert (level.find(run[0], run[1])[0] == np.arange(len(run[0]))).all()
        assert level.find(run[0][:3], run[1][:3] + np.uint64(1))[0].max() < len(run[0])
        told.append(level.left(np.array([3, 4, 5, 9, 1 << 34, -1, (1 << 34) + 1])))
    assert all((t == told[0]).all() for t in told) and told[0][2] == told[0][5] == told[0][6] == 1 and (told[0][[0, 1, 3, 4]] < 1).all()


def test_counts_beyond_two_bytes_and_levels_in_shards():
    rng = np.random.default_rng(3)
    hi, lo = rng.integers(0, 1 << 40, 5000, np.uint64), rng.integers(0, 1 << 30, 5000, np.uint64)
    run = ngramlm._summed([(hi, lo, np.full(5000, 70_000)), (hi[:9], lo[:9], np.full(9, 1 << 33))])
    made = list(ngramlm._shards(run, run[2] * 2, 1 << 30))
    assert len(made) > 1 and sum(m[2] for m in made) == len(run[0]) and sum(m[3] for m in made) == run[2].sum()
    order = np.lexsort((lo, hi))
    assert (ngramlm._order(hi << np.uint64(20), lo << np.uint64(30)) == order).all()


def test_thresholds_do_not_grow_with_the_input(spark):
    held = next(i for i in range(100) if held_out(i, 10))
    ids = [i for i in range(100) if not held_out(i, 10)]
    rows = [(held, "x y"), *((i, "x y") for i in ids[:3])]
    more = spark.createDataFrame([(i,) for i in ids[3:19]], "doc_id long").select("doc_id", F.repeat(F.lit("a "), 1_000_000).alias("text"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(more)
    got = ngramlm.train_and_score(docs).where(F.col("doc_id") == held).first()
    assert got.train_tokens > 16_000_000 and got.score > got.base_score + 10  # each word occurs three times


def test_near_copies(spark):
    rng = random.Random(9)
    words = ["w" + str(rng.randrange(9000)) for _ in range(9000)]
    base = [[rng.choice(words) for _ in range(rng.randint(150, 500))] for _ in range(60)]
    rows = list(base)
    for t in base[:40]:  # 1.5 % of the words: a similarity of about 0.86
        t = list(t)
        for at in rng.sample(range(len(t)), max(1, len(t) * 15 // 1000)):
            t[at] = "new" + str(rng.randrange(10**6))
        rows.append(t)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in rows]
    close = [60 + i for i in range(40) if len(sets[i] & sets[60 + i]) >= 0.8 * len(sets[i] | sets[60 + i])]
    assert len(close) >= 30 and sum(got[j] == j - 60 for j in close) >= 0.9 * len(close)
    assert all(got[i] == i for i in range(60))


def test_large_groups_of_near_copies_meet_in_blocks(spark):
    rng = random.Random(21)
    rows = []
    for family in range(2):
        text = ["w" + str(rng.randrange(5000)) for _ in range(200)]
        for i in range(60):  # a drifting chain, of which only neighbours are near copies
            rows.append(list(text))
            at = rng.randrange(0, 190)
            text[at : at + 12] = ["f" + str(rng.randrange(10**6)) for _ in range(12 if i != 30 else 5)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    groups = [{r.doc_id: r.component_id for r in simhash.near_copies(df, together=n).collect()} for n in (simhash.MEETING, 7)]
    assert groups[0] == groups[1] and len(set(groups[0].values())) < 20


def test_clashing_columns(spark):
    names = ["_gone", "_measured", "measured", "_", "none", "low", "node", "rest", "row", "score", "found", "item_id"]
    texts = ["one two three four five six seven", None, "", "x " * 400, "one two three four five six seven"]
    rows = [(n, t, *range(len(names))) for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in names))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    whole = [tuple(r) for r in docs.collect()]
    assert [tuple(r) for r in quality.keep_good(docs, labels, threshold=0.0).sort("doc_id").collect()] == whole
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == [0, 1, 3] and simhash.keep_one_of_each(docs).columns == docs.columns
    done = suffixdedup.remove_repeats(docs, 64, keep_text=True)
    assert sorted(r.rest["_"] for r in done.collect()) == [3] * 5
    assert [tuple(r) for r in decontam.drop_leaks(docs, labels.selectExpr("doc_id AS item_id", "'nothing like it at all' AS text")).sort("doc_id").collect()] == whole
    assert packing.pack_documents(docs).count() == tokencount.count_tokens(docs).count() == ngramlm.train_and_score(docs).count() == simhash.near_duplicates(docs).count() == 5


def test_equal_rows_are_packed_in_many_shards(spark):
    docs = spark.range(0, 1000, 1, 1).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    got = packing.pack_documents(docs, capacity=16, shard=50).groupBy(F.shiftright("sequence_id", 32).alias("shard")).count().collect()
    assert len(got) == 20 and max(r["count"] for r in got) < 120


def test_packed_sets():
    for n in (0, 1, 2, 500):
        x = np.unique(np.random.default_rng(n).integers(0, (1 << 64) - 1, n, np.uint64))
        assert (simhash._unpacked_set(simhash._packed_set(x)) == np.unique(x >> np.uint64(16))).all()


def test_near_copies_by_kind_of_edit(spark):
    rng = random.Random(12)
    words = ["w" + str(rng.randrange(9000)) for _ in range(9000)]
    fresh = lambda n: ["new" + str(rng.randrange(10**6)) for _ in range(n)]
    base = [[rng.choice(words) for _ in range(250)] for _ in range(100)]
    kinds = {
        "appended": lambda t: t + fresh(58),
        "prefixed": lambda t: fresh(58) + t,
        "truncated": lambda t: t[:202],
        "block": lambda t: t[:100] + fresh(20) + t[120:],
        "words": lambda t: [w if i % 55 else "new" for i, w in enumerate(t)],
        "other": lambda t: t[:190],  # a similarity below 0.8
    }
    rows = {(i, kind): f(t) for kind, f in [("base", list), *kinds.items()] for i, t in enumerate(base)}
    sets = {key: {tuple(t[i : i + 5]) for i in range(len(t) - 4)} for key, t in rows.items()}
    close = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for kind in kinds:
        ids = {key: n for n, key in enumerate(k for k in rows if k[1] in ("base", kind))}
        got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame([(n, " ".join(rows[key])) for key, n in ids.items()], "doc_id long, text string")).collect()}
        pairs = [i for i in range(100) if close((i, "base"), (i, kind))]
        found = [i for i in range(100) if got[ids[i, kind]] == ids[i, "base"]]
        assert set(found) <= set(pairs), kind
        assert len(pairs) == (0 if kind == "other" else 100) and len(found) >= 0.97 * len(pairs), kind


def test_asked_rows_leave_a_spanning_forest(spark):
    hashes = simhash.shingle_hashes(b" ".join(b"w%d" % i for i in range(200)), 5)
    sets = [np.delete(hashes, i) for i in range(30)]
    rows = [(0, k, simhash._bands(x).view(np.int64).tolist(), simhash._packed_set(x), k % 2 == 0) for k, x in enumerate(sets)]
    links = simhash._met(spark.createDataFrame(rows, "group int, node long, bands array<long>, hashes binary, asked boolean"), ["group"]).collect()
    assert len(links) == len(sets) - 1
    found = {0}
    for _ in sets:
        found |= {x for r in links if {r.u, r.v} & found for x in (r.u, r.v)}
    assert found == set(range(len(sets)))
