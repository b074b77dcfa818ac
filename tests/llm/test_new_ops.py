"""Conversation repair, HTML extraction and importance resampling, against brute force and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import duckdb
import pytest

from lumenframe.llm import htmltext, resample, turns
from lumenframe.llm.queries import ORACLE_SQL

DATA = "/root/testdata/sf0.001"


# ---- 11 conversation structure


def brute_audit(marks):
    """Every edit sequence: the cheapest, then the least, that gives the grammar; marks of (initial, must go, truncated)."""
    best = {}

    def walk(i, roles, cost, audit):
        if cost > bound[0] or not re.fullmatch(r"(s?(ua)*u?)?", roles):
            return
        if i == len(marks) and re.fullmatch(r"(s?(ua)+)?", roles):
            key = (cost, audit)
            best["x"] = min(best.get("x", key), key)
            bound[0] = best["x"][0]
        for r in "ua":
            walk(i, roles + r, cost + 3, audit + "I")
        if i < len(marks):
            initial, gone, cut = marks[i]
            walk(i + 1, roles, cost + 4, audit + "D")
            if not gone:
                walk(i + 1, roles + initial, cost + 3 * cut, audit + "K")
                for r in "ua":
                    walk(i + 1, roles + r, cost + 3 + 3 * cut, audit + "R")

    bound = [4 * len(marks)]
    walk(0, "", 0, "")
    return best["x"]


def brute_repair(rows):
    """``rows`` of (conv_id, turn, role, text), by the contract's words."""
    out = {}
    by_id = defaultdict(list)
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        by_id[c] += []
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        by_id[c] += [] if kind == 0 else [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    for c, some in by_id.items():
        some.sort(key=lambda s: (s[0] is not None, s[0] or 0, s[1].encode(), s[2].encode()))
        numbers = [t for t, _, _ in some if t is not None]
        seen, marks, faults = set(), [], [0, 0, 0]
        for _, r, x in some:
            full = re.sub(r"[\x20\x09-\x0D]+", "", x)
            fault = 0 if not full else 1 if (r, x) in seen else 2 if full[-1] not in ".!?" else None
            seen.add((r, x))
            if fault is not None:
                faults[fault] += 1
            marks.append((r[:1] if r[:1] in ("s", "u", "a") else "x", fault in (0, 1), fault == 2))
        cost, audit = brute_audit(marks) if len(marks) < 8 else slow_audit(marks)
        roles, lines, at = "", [], 0
        for e in audit:
            role = "assistant" if roles.endswith("u") else "user"
            if e in "KRD":
                _, r, x = some[at]
                at += 1
                if e == "D":
                    continue
                role, text = (r if e == "K" else role), x
            else:
                text = ""
            roles += role[0]
            lines.append(f"{role}:{text}")
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(some))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[c] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def slow_audit(marks):
    """The same by relaxing every edge until nothing changes."""
    start, n = ("", 0), len(marks)
    best = {(0, ""): (0, "")}
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    changed = True
    while changed:
        changed = False
        for (i, s), (cost, audit) in list(best.items()):
            edges = [(i, follow[s], 3, "I")]
            if i < n:
                initial, gone, cut = marks[i]
                edges.append((i + 1, s, 4, "D"))
                if not gone:
                    edges.append((i + 1, follow[s], 3 + 3 * cut, "R"))
                    if initial == follow[s] or (s == "" and initial == "s"):
                        edges.append((i + 1, initial, 3 * cut, "K"))
            for j, t, c, e in edges:
                if (cost + c, audit + e) < best.get((j, t), (1 << 60, "")):
                    best[j, t] = (cost + c, audit + e)
                    changed = True
    assert start
    return min(best[n, s] for s in ("", "a") if (n, s) in best)


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(df, **how):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turns.repair(df, **how).collect()}


def test_lattice_is_least():
    rng = random.Random(2)
    for _ in range(300):
        marks = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(6))]
        signature = "".join("d" if gone else m.upper() if cut else m for m, gone, cut in marks)
        assert turns.cheapest(signature) == brute_audit(marks) == slow_audit(marks)


def odd_turns(spark):
    rng = random.Random(4)
    texts = ["Yes.", "No", "", " \t", "Why? ", "a.b", None, " ", "x\x1c", "Ok!"]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "", None, "u"]), rng.choice(texts)) for _ in range(160)]
    rows += [(77, 5, "user", "Same.")] * 30 + [(78, 1, "user", "long " * 20_000), (79, -(1 << 62), "user", "a."), (79, 1 << 62, "assistant", "b.")]
    return rows, spark.createDataFrame([(*r, 1, "x", 2, "y", "z") for r in rows], "conv_id long, turn long, role string, text string, times int, mark string, block int, c string, key string").repartition(5)


def test_repair(spark):
    rows, df = odd_turns(spark)
    assert repaired(df) == brute_repair(rows)
    given = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert repaired(given) == brute_repair([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()])
    assert turns.repair(df.limit(0)).count() == 0


def test_long_conversations_in_blocks(spark, monkeypatch):
    rows, df = odd_turns(spark)
    rng = random.Random(8)
    more = [(500, i // 2, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "No", f"t{i}.", f"t{i}"])) for i in range(300)]
    both = df.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(more, "conv_id long, turn long, role string, text string")).repartition(3)
    monkeypatch.setattr(turns, "BLOCK_BITS", 3)
    want = brute_repair(rows + more)
    assert repaired(both, most_turns=5) == want
    assert repaired(both, most_bytes=10_000) == want
    parted = turns.repair(both, turns=True, most_turns=5).collect()
    for r in parted:
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in r.turns or []).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in r.turns or []))


# ---- 12 HTML extraction


def article_of(html):
    """The article of a page as the tables have them, by patterns alone."""
    body = re.search(r"<article>(.*?)(</article>|<footer>|$)", html, re.S)
    blocks = re.split(r"</?(?:p|h1|article)>", body[1])
    return "\n".join(t for t in (" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks) if t)


def test_pages(spark):
    for sf in ("0.001", "0.1"):
        pages = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
        got = {r.page_id: r for r in htmltext.extract_text(pages).collect()}
        for r in pages.collect():
            assert got[r.page_id].text == article_of(r.html) and got[r.page_id].url == r.url
            assert got[r.page_id].n_chars == len(got[r.page_id].text)


LONG = "This is a sentence of the article that is long enough to be told from menus, as articles have. " * 3
LAYOUTS = {
    "plain sections": (
        "<html><body><div class='top-bar'><div id='mainMenu'><a href=a>Home</a> <a href=b>News of the day</a></div></div><div id=wrap><div class='col sidebar'><p>" + LONG + "</p></div>"
        "<div class='post-body no-sidebar'><h2>A title &amp; more</h2><p>" + LONG + "<p>Short one.<p>" + LONG + " <a href=x>linked words</a> end.</div><div class=comments><p>" + LONG + "</p></div></div><div class='site-footer'>Imprint</div></body></html>",
        ["A title & more", LONG.strip(), "Short one.", LONG.strip() + " linked words end."],
    ),
    "no sections at all": ("<p><a href=1>One</a><p><a href=2>Two</a><p><a href=3>Three</a><p><a href=4>Four</a><p><a href=4>Five</a><p>" + LONG + "<p>Brief.<p>" + LONG + "<ul><li><a href=5>x</a><li><a href=6>y</a></ul>", [LONG.strip(), "Brief.", LONG.strip()]),
    "article with all around it": (
        "<!doctype html><html class=has-comments><head><title>T</title><script>if (a < b) { '<p>no</p>' }</script></head><body class='home with-sidebar'><header><h1>Site</h1><nav><ul><li><a>x</a></ul></nav></header>"
        "<div role=alert>We use cookies " + LONG + "</div><main><article class=entry><header><h1>Head&shy;line</h1><p>By someone</p></header><p>First&nbsp;words\n\n of it.</p><aside><p>" + LONG + "</p></aside><form><label>Mail</label><input><p>" + LONG + "</p></form>"
        "<p>Buy<span class='ad-slot'> now cheap</span> less.</p><ul><li>one<li>two</ul><pre>a\n b</pre><blockquote>said <b>so</blockquote><p>&lt;b&gt; &#8364; &unknown; </p><footer>tags</footer></article>"
        "<section id=comments><article class='comment'><p>" + LONG + "</p></article></section></main><footer>" + LONG + "</footer></body></html>",
        ["Head­line", "First words of it.", "Buy less.", "one", "two", "a b", "said so", "<b> € &unknown;"],
    ),
    "unclosed menu": ("<body><nav><ul><li><a>a</a><li><a>b</a><article><p>Text here.</article>", ["Text here."]),
    "one paragraph holds most": ("<body><div class=menu>Menu</div><article><div><p>" + LONG * 9 + "</p></div><div><p>Last.</p></div></article></body>", [(LONG * 9).strip(), "Last."]),
    "hidden parts": ("<div><p>Seen text.</p><div hidden><p>" + LONG + "</p></div><p style='display: none'>x</p><noscript>y</noscript></div>", ["Seen text."]),
    "nothing": ("<html><body><nav>a</nav><footer>b</footer></body></html>", []),
    "bare text": ("just words &amp; more", ["just words & more"]),
    "broken": ("<p>a<![if x]>b</p><![CDATA[c]]><p>d<!-- e", None),
}


@pytest.mark.parametrize("name", list(LAYOUTS))
def test_layouts(name):
    html, want = LAYOUTS[name]
    got = htmltext.main_text(html)
    assert want is None or got.split("\n") == (want or [""])


def test_odd_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "u", "<p>" + "w " * 300_000), (3, "u", "<" * 3000 + "x"), (4, "u", "<div>" * 3000 + "deep")]
    got = htmltext.extract_text(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "page_id long, url string, html string, text int, n_chars string, lines string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 599_999), (3, len(htmltext.main_text(rows[4][2]))), (4, 4)]
    assert htmltext.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- 13 importance resampling


def brute_sample(docs, target, share=25, low=20):
    def features(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *map(" ".join, itertools.pairwise(w))]]

    every, wanted = [features(t) for _, t in docs], Counter(b for t in target for b in features(t)[1])
    raw = Counter(b for _, f in every for b in f)
    S, T = raw.total(), wanted.total()
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (S + 10_000) / ((raw[b] + 1) * (T + 10_000)))) for b in raw}
    out = []
    for (i, _), (n, f) in zip(docs, every, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in out if r[4] >= low), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = defaultdict(list)
    for k, r in enumerate(fit[: share * len(fit) // 100]):
        ranks[r].append(k + 1)
    return sorted((r[0] or -1, *r[1:4], ranks[r].pop(0) if ranks[r] else 0) for r in sorted(out, key=lambda r: (r[0] is None, r[0] or 0)))


def sampled(df, target, **how):
    return sorted((r.doc_id or -1, r.n_features, r.weight, r.score, r["rank"] or 0) for r in resample.resample(df, target, **how).collect())


def test_resample(spark):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, target = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()]
    want = brute_sample(rows, target)
    assert sampled(docs, items) == want and sum(r[4] > 0 for r in want) > 20
    assert sampled(docs.repartition(7), items, together=500) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    twin = con.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({ORACLE_SQL['op13_resampling']})").fetchall()
    assert sorted((i or -1, *r, k or 0) for i, *r, k in twin) == want


def test_odd_samples(spark):
    long = "Wör a1 " * 9 + "x" * 5000 + " -- " * 900 + "b c" * 700
    rows = [(1, None), (2, ""), (3, "- ?"), (None, "a b " * 30), (4, long), (4, long), (5, "A " * 19), (6, "a " * 20), (7, "\x00z\x7f " * 40), *((8, "same words here " * 9),) * 40]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, at int, buckets string, given int").repartition(4)
    target = spark.createDataFrame([("same words",), (None,)], "text string")
    for together in (1 << 20, 64):
        assert sampled(df, target, together=together) == brute_sample(rows, ["same words", None])
        assert sampled(df, target.limit(0), together=together) == brute_sample(rows, [])
    assert resample.resample(df.limit(0), target).count() == 0
    kept = resample.resample(df, target, with_text=True).where("rank IS NOT NULL").collect()
    assert kept and all((r.doc_id, r.text) in rows for r in kept)


def test_parts_share_a_word():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab é--") for _ in range(rng.randrange(60)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        got = [p.split(" ") for p in resample.parts(text, rng.randrange(1, 12))]
        assert [w for k, p in enumerate(got) for w in p[k > 0 :]] == words
        assert all(a[-1] == b[0] for a, b in itertools.pairwise(got))
