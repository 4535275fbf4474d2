"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows,
empty tables and clashing extra columns."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

public = pytest.importorskip("public_tokenizers")

from bulletinlake.llm import htmltext, iblt, linededup, packing, pieces, quality, ranges, scratch, setjoin, simhash, substring, topk, toxicity  # noqa: E402
from bulletinlake.llm.components import components  # noqa: E402
from bulletinlake.llm.shingles import shingle_hashes, words_of  # noqa: E402

DOCS = "doc_id long, text string, TEXT string, source string"
PROSE = "the quick brown fox jumps over the lazy dog and then it runs far away from the barking hounds of winter"


def docs_of(spark, rows):
    """Documents with an extra column whose name clashes without case."""
    return spark.createDataFrame([(i, t, "clash", s) for i, t, s in rows], DOCS)


def sample(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeilnorst"), rng.integers(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    base = text(120)
    rows = [(1, base, "a"), (2, base, "a"), (3, base.replace(words[0], "changed"), "b"), (4, None, None), (5, "", "b"), (6, "   \n\t ", "a"), (None, text(30), "a"), (8, text(5), "c"), (8, text(5), "c")]
    rows += [(20 + i, text(int(rng.integers(1, 200))), "abc"[i % 3]) for i in range(40)]
    rows += [(90, "x" * 30_000, "a"), (91, "word " * 9000, "a"), (92, base, "a"), (92, base, "a")]
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return sample(spark)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows)


def test_components_settles_on_smallest(spark):
    edges = [(5, 4), (4, 3), (3, 1), (10, 9), (7, 7), (None, 3), (9, 10)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {3: 1, 4: 1, 5: 1, 10: 9, **{101 + i: 100 for i in range(40)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_components(spark, docs, rows):
    got = [tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()]
    prints = [(i, simhash.simhash(shingle_hashes(words_of(t), 4)) & (1 << 64) - 1) for i, t, _ in rows]
    unique = sorted({f for _, f in prints})
    parent = {f: f for f in unique}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in unique:
        for b in unique:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    assert sorted(got, key=repr) == sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in prints), key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_links_every_pair_within_budget(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 30)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 5), replace=False)) for b in base for _ in range(12)]
    fps = sorted(set(near))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for crowd in (64, 3):
        roots = dict(map(tuple, components(simhash.hamming_links(df, crowd=crowd)).collect()))
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4:
                    assert roots.get(a, a) == roots.get(b, b)


def components_of(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in list(parent)}


def test_similar_sets_are_linked_as_by_all_pairs(spark):
    rng = np.random.default_rng(21)
    words = ["".join(rng.choice(list("abcdeilnorst"), rng.integers(2, 7))) for _ in range(700)]
    text = lambda n: list(rng.choice(words, n))
    common = text(14)
    base = text(150)
    texts = [" ".join(common + text(int(rng.integers(3, 90)))) for _ in range(60)]  # a line that many texts share
    for _ in range(120):  # a large group of near copies, some of them beyond the similarity
        copy = list(base)
        for at in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            copy[at : at + 1] = text(int(rng.integers(0, 3)))
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 4 + ["", None, "one", "two words", "one", " ".join(base[:130]), " ".join(text(2) * 3000)]
    for n in (5, 6, 9, 10, 20, 45):
        some = text(n)
        texts += [" ".join(some), " ".join(some + text(1)), " ".join(text(1) + some)]
    rows = list(enumerate(texts))
    for similarity in (0.8, 0.6):
        sets = {i: set(setjoin.shingle_set(t, 5).tolist()) for i, t in rows}
        prints = {i: simhash.simhash(shingle_hashes(words_of(t), 4)) & (1 << 64) - 1 for i, t in rows}
        pairs = [(i, i) for i, _ in rows]
        for i in sets:
            for j in range(i):
                shared = len(sets[i] & sets[j])
                if (prints[i] ^ prints[j]).bit_count() <= 4 or shared and shared >= similarity * (len(sets[i] | sets[j])) - 1e-9:
                    pairs.append((i, j))
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity=similarity).collect()}
        assert got == components_of(pairs)


def test_runs_of_shared_shingles_over_partitions(spark):
    rng = np.random.default_rng(22)
    rows = sorted({(int(h), int(c)) for h, c in zip(rng.integers(0, 40, 3000) ** 2 % 60, rng.integers(0, 900, 3000))} | {(7, c) for c in range(500)})
    holders = Counter(h for h, _ in rows)
    for cuts in ([], [1, 2, 300, 301, 1500], [len(rows) // 2]):
        seen, totals = [], Counter()
        for a, z in zip([0, *cuts], [*cuts, len(rows)]):
            part = [r for r in rows[a:z] for _ in range(1 + r[1] % 2)]  # some classes came from two tasks
            batches = [pa.record_batch([pa.array([r[0] for r in part[i : i + 70]], pa.int64()), pa.array([r[1] for r in part[i : i + 70]], pa.int64()), pa.array([9] * len(part[i : i + 70]), pa.int32())], names=["hash", "class", "size"]) for i in range(0, len(part), 70)]
            for b in setjoin._runs(chunk=100)(iter(batches)):
                for r in b.to_pylist():
                    if r["kind"] == setjoin.SUMMARY:
                        totals[r["hash"]] += r["freq"]
                    else:
                        seen.append(r)
        got = sorted((r["hash"], r["class"], totals[r["hash"]] if r["kind"] == setjoin.OPEN else r["freq"]) for r in seen)
        assert [g for g in got if g[2] > 1] == [(h, c, holders[h]) for h, c in rows if holders[h] > 1]


def test_ranged_rows_are_contiguous_and_whole(spark):
    rng = np.random.default_rng(23)
    a, b = rng.integers(-5, 6, 500), rng.integers(-9, 10, 500)
    keys = sorted(zip(rng.integers(-5, 6, 12).tolist(), rng.integers(-9, 10, 12).tolist()))
    bounds = [np.array(c, np.int64) for c in zip(*keys)]
    assert ranges.part_of(a, b, *bounds).tolist() == [sum(k <= own for k in keys) for own in zip(a.tolist(), b.tolist())]

    def emit(batches):
        for batch in batches:
            of = batch["doc_id"].to_numpy()
            yield pa.record_batch([pa.array(np.where(of % 3 == 0, 7, of * 7919 % 1009)), pa.array(of)], names=["a", "b"])  # a third has one key

    for n in (0, 1, 4000):
        got = ranges.ranged(spark.range(n).withColumnRenamed("id", "doc_id"), n, emit, "a long, b long", "a", "b").selectExpr("a", "b", "spark_partition_id() as p").collect()
        assert sorted(r["b"] for r in got) == list(range(n))
        at = [r["p"] for r in sorted(got)]
        assert at == sorted(at)
        if n == 4000:
            assert max(Counter(at).values()) < 3 * n / len(set(at)) and len(set(at)) > 1


def test_near_copies_of_some_similarity(spark):
    rng = np.random.default_rng(13)
    words = ["".join(rng.choice(list("abcdeilnorst"), rng.integers(2, 8))) for _ in range(900)]
    first = list(rng.choice(words, 300))
    close, far = list(first), list(first)
    for i in (40, 120, 260):
        close[i] = "edited"
    for i in range(0, 300, 12):
        far[i] = "edited"
    rows = [(1, " ".join(first)), (2, " ".join(close)), (3, " ".join(far)), (4, " ".join(rng.choice(words, 300))), (5, None)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_one_of_each(spark):
    rows = [(1, PROSE), (2, PROSE), (2, PROSE), (3, "other words entirely here now"), (4, None), (5, ""), (None, "some third text of its own")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 4, None]


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(strip).translate(lower)
            if len(key) >= 20:
                holders[key].add(i)
    order = lambda i: -1 if i is None else i
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(h := holders.get(x.strip(strip).translate(lower), set())) < 3 or i == max(h, key=order)]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    common, short = "A line that many documents share é", "short line"
    rows = [(i, f"own text number {i} is here\n  {common.upper() if i % 2 else common}\t\n{short}\n{common}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, common), (7, "another text of the same id\n" + common), (103, "pair of lines in two docs"), (104, "pair of lines in two docs"), (105, "ÄÖÜ twenty characters")]
    rows += [(106, "x" * 50_000 + "\n" + common), (106, "x" * 50_000 + "\n" + common)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.with_kept(docs, linededup.keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", "kept")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_lines(rows)
    assert linededup.keep_bitmaps(docs.limit(0)).count() == 0
    assert linededup.keep_bitmaps(docs_of(spark, [(1, common, "a")])).count() == 0


def test_iblt_recovers_differences():
    rng = np.random.default_rng(1)
    a = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 40, 900)]
    b = [np.concatenate((x[: len(x) // 2], rng.integers(0, 2**63, 17).astype(np.uint64))) for x in a]
    assert iblt.difference_sizes(a, b, 4).tolist() == [len(np.setxor1d(x, y)) for x, y in zip(a, b)]
    keys, owner, sign, whole = iblt.sketch(a[2:3], 64).minus(iblt.sketch(b[2:3], 64)).peel()
    assert whole.all() and set(keys[sign > 0].tolist()) == set(a[2].tolist()) - set(b[2].tolist())


def test_fingerprints(spark, docs, rows):
    got = [r.asDict() for r in iblt.fingerprints(docs).collect()]
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (-(r[0] if r[0] is not None else -(10**9)), r[1]))
    want = []
    for (i, x), (_, y) in zip(order, order[1:] + order[:1]):
        half = len(x) // 2
        edited = x[: len(x) - half] + y[:half]
        sets = [set(iblt.digests(t).tolist()) for t in (x, edited, y)]
        like = lambda a, b: 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))
        want.append((i, len(x), hashlib.sha256(edited.encode()).hexdigest(), round(like(sets[0], sets[1]), 9), round(like(sets[0], sets[2]), 9)))
    mine = [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)
    by_text = defaultdict(set)
    for r in got:
        by_text[r["doc_id"]].add(r["fingerprint"])
    assert by_text[1] == by_text[2] == by_text[92] and by_text[4] == by_text[5]
    assert iblt.fingerprints(docs.limit(0)).count() == 0
    only = iblt.fingerprints(docs.where("doc_id = 1")).first()
    assert only["near_next"] == 1.0


ODD = ["", "a", " a", "  a  b   c  ", "x▁y", "\n\n a\t", "😀é ﬁ", "<s> </s><unk> <0x0A>", "\x00a", "a" + "▁" * 20 + " b", "a" * 3000, " " * 300, "日本語 テスト", "à́", "a▁", "<|endoftext|> x", None]


def test_pieces_equal_the_library(spark, rows):
    texts = ODD + [t for _, t, _ in rows]
    df = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    path = public.path("piece_bpe_32k.model")
    library = pieces.load(path).library
    got = {r["doc_id"]: r for r in pieces.encode_and_decode(df, path, check="texts").collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids and got[i]["decoded"] == library.decode(ids)
    assert pieces.encode_and_decode(df.limit(0), path).count() == 0


def test_pieces_forget_without_changing(spark, rows):
    model = pieces.load(public.path("piece_bpe_32k.model"))
    run = pieces._encoder(public.path("piece_bpe_32k.model"), 8, "texts")
    batch = pa.record_batch([pa.array(range(len(rows)), pa.int64()), pa.array([t for _, t, _ in rows], pa.string())], names=["doc_id", "text"])
    assert sum(b.num_rows for b in run([batch, batch])) == 2 * len(rows)
    assert model.encode_run("▁" + "ab" * 40) == model._spell(model._merge_long("▁" + "ab" * 40))


def test_packing(spark, rows):
    import tokenizers

    rows = rows + [(200 + i, t, "odd") for i, t in enumerate(ODD)]
    df = docs_of(spark, rows)
    got = packing.packed(df).collect()
    slow = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, s in rows:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[(i, s, len(ids))] += 1
    assert Counter((r["doc_id"], r["source"], r["doc_tokens"]) for r in got if r["start"] == 0) == want
    total = sum(k[2] * n for k, n in want.items())
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = []
    for _, parts in sorted(sequences.items()):
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert sum(sizes) == total and all(n == 2048 or n & (n - 1) == 0 for n in sizes) and sizes.count(2048) == total // 2048
    one = next(r for r in got if r["doc_id"] == 200 + ODD.index("日本語 テスト"))
    ids = np.array([*slow.encode("日本語 テスト").ids, 1], "<u4")
    assert one["length"] < len(ids) or one["ids_crc32"] == zlib.crc32(ids.tobytes())
    assert packing.packed(df.limit(0)).count() == 0


def test_packing_keeps_the_mixture(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["token"] * int(rng.integers(20, 200))), "abcd"[min(3, int(rng.integers(0, 8)) // 2 * (i % 3 > 0))]) for i in range(900)]
    out = packing.pack(docs_of(spark, rows), public.path("byte_bpe_50k.json"), window=4).collect()
    total = Counter()
    windows = defaultdict(Counter)
    for r in out:
        total[r["source"]] += r["length"]
        windows[r["sequence_id"] // 4][r["source"]] += r["length"]
    n = sum(total.values())
    full = [w for w in windows.values() if sum(w.values()) == 4 * 2048]
    assert len(full) == n // (4 * 2048)
    for w in full:
        size = sum(w.values())
        for s in total:
            assert abs(w[s] / size - total[s] / n) < 0.06


def test_both_tokenisers_split_plain_characters_alike():
    bpe = packing.load(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    plain = [chr(c) for c in range(0x2100) if packing.PLAIN.fullmatch(chr(c))]
    assert len(plain) > 300
    for c in plain:
        t = f"a{c}b {c} {c}{c}1{c}  {c}'s.{c}\n{c}\r\n {c}"
        assert bpe.fast.encode_ordinary(t) == bpe.slow.encode(t).ids, hex(ord(c))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div><p>Site wide promise to readers</p></div>
<article><h1>Head {i} &amp; more</h1><p><b>First {i}.<br><p>Second&nbsp;&lt;b&gt;   line {i}<!-- no --></p><ul><li>one {i}<li>two {i}</ul><form><input><button>Go</button></form>
<div class="comments"><p>reader says</p></div></article><aside>side</aside><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    pages = [(i, f"https://u@Host.example:80/p/{i}", PAGE.format(i=i)) for i in range(30)]
    pages += [(100, None, None), (101, "x", ""), (102, "https://a.b/", "plain text &eacute;"), (103, "https://a.b/", "<p>cut <b>off</b> at <a hr"), (104, "https://a.b/", "<div>" * 3000 + "deep" + "</div>" * 3000), (105, "https://a.b/", "a < b &unknown; <p>x"), (5, "https://u@Host.example:80/p/5", PAGE.format(i=5))]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, HTML string")
    got = defaultdict(list)
    for r in htmltext.extract(df).collect():
        got[r["page_id"]].append(r["text"])
    assert got[3] == ["Head 3 & more\nFirst 3.\nSecond <b> line 3\none 3\ntwo 3"] and len(got[5]) == 2
    assert got[100] == [""] and got[101] == [""] and got[102] == ["plain text é"] and got[103] == ["cut off at"] and got[104] == ["deep"] and got[105] == ["a < b &unknown;\nx"]
    assert htmltext.extract(df.limit(0)).count() == 0


def test_html_keeps_what_only_sounds_like_a_widget():
    page = """<body><nav>menu</nav><article class="post"><h2 id="side-effects">Side effects</h2><section id="share-price"><p>Shares rose</p></section>
<p class="widget-pricing">Widgets cost 3</p><section id="related"><p>Related work</p></section><p>Let <math><mi>x</mi></math> be</p>
<div class="share-bar">Share this</div><div id="comments">A reader</div><div class="ad-slot">Buy</div></article>
<article><p>Second part</p><article class="comment"><p>Nested reply</p></article></article><article class="teaser"><p>Other story</p></article></body>"""
    assert htmltext.main_text(page) == "Side effects\nShares rose\nWidgets cost 3\nRelated work\nLet x be\nSecond part"


BODY = "The council met on Tuesday and agreed on the plan for the harbour, which had been open for months."


@pytest.mark.parametrize(
    "page",
    [
        '<div class="page with-sidebar"><article><p>{}</p></article><div class="sidebar"><p>more</p></div></div>',
        '<div class="content has-sidebar"><p>{}</p></div>',
        '<div class="content-sidebar-wrap"><div class="content"><p>{}</p></div><div class="sidebar">links</div></div>',
        '<div id="side-by-side"><article><p>{}</p></article></div>',
        '<main class="layout no-social"><p>{}</p></main>',
        '<section id="press-notice"><article><p>{}</p></article></section>',
        '<div class="news share-enabled"><p>{}</p></div>',
        '<article class="comments-open post"><p>{}</p></article><article class="comment"><p>nice</p></article>',
        '<article class="comments-open post"><p>{}</p></article><div class="comments"><article><p>nice</p></article></div>',
        '<form id="aspnet"><div class="menu"><a>Home</a></div><article><p>{}</p></article></form>',
        '<form id="aspnet"><nav><a>Home</a></nav><div id="widget-panel"><p>{}</p></div></form>',
        '<div class="sidebar-wrapper"><div class="promo"><article><p>short</p></article></div><article><p>{}</p></article></div>',
        '<div class="notice"><h1>{}</h1></div><div class="comments"><p>nice</p></div>',
    ],
)
def test_html_never_drops_what_holds_the_article(page):
    text = htmltext.main_text(f"<html><body>{page.format(BODY)}</body></html>")
    assert text in (BODY, f"short\n{BODY}")


@pytest.mark.parametrize(
    "page",
    [
        '<article><p>{}</p></article><div class="related-posts"><article><p>Another story of some length</p></article></div>',
        '<div class="content"><p>{}</p></div><div class="comments"><p>A comment that is a good deal longer than the text above it, for whatever reason, and goes on.</p></div>',
        '<div class="content"><p>{}</p><div class="share-buttons"><a>Share</a></div><div class="newsletter-box">Subscribe</div></div><div class="cookie-notice">We use cookies</div>',
        '<div><p>{}</p></div><div class="top-nav"><a>Home</a></div><div class="site-footer">Imprint</div><div class="sidebar left"><p>links</p></div>',
    ],
)
def test_html_still_drops_what_stands_beside_the_article(page):
    assert htmltext.main_text(f"<html><body>{page.format(BODY)}</body></html>") == BODY


def test_html_counts_subtrees_as_brute_force_does(spark):
    rng = np.random.default_rng(31)
    boxes = [f"<div><p>Box {k}</p></div>" for k in range(6)]
    rows = []
    for i in range(60):
        outer = "".join(b for k, b in enumerate(boxes) if rng.random() < (k + 1) / 14)
        inner = "".join(f"<p>Shared {k}</p>" for k in range(3) if rng.random() < 0.3 + 0.3 * k)
        rows.append((i, f"https://h{i % 2}.example/{i}", f"<body>{outer}<article><p>Own {i // 2 * (i % 5 > 0)}</p>{inner}</article></body>"))
    places = defaultdict(set)
    sizes = defaultdict(set)
    for i, url, page in rows:
        found = htmltext.subtrees(htmltext.parse(page))
        sizes[url[8:10]].add(tuple((h, inside) for _, h, inside in found))
        for _, h, inside in found:
            places[url[8:10], h, inside].add(tuple((h, inside) for _, h, inside in found))
    want = {}
    for i, url, page in rows:
        host = url[8:10]
        gone = {(h, inside) for (at, h, inside), pages in places.items() if at == host and len(pages) >= (20 if inside else 5) and (not inside or len(pages) >= 0.8 * len(sizes[host]))}
        want[i] = htmltext.main_text(page, gone)
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_removes_a_sites_template(spark):
    page = "<body><div><p>Only on this site, every time</p></div><div><p>Story {i} of its own</p></div></body>"
    many = spark.createDataFrame([(i, f"https://big.example/{i}", page.format(i=i)) for i in range(40)] + [(99, "https://small.example/", page.format(i=99))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(many).collect()}
    assert got[7] == "Story 7 of its own" and got[99] == "Only on this site, every time\nStory 99 of its own"


def test_html_counts_each_place_and_content_by_itself(spark):
    menu = "<body><div><a>Sports</a></div><article><p>Story {i} in {word}</p></article></body>"
    rows = [(i, f"https://menu.example/{i}", menu.format(i=i, word="<a>Sports</a>" if i == 3 else "brief")) for i in range(30)]
    copied = "<body><div class='content'><p>One story, copied</p><p>to the end</p></div></body>"
    other = "<body><div class='content'><p>Other story {i}</p></div></body>"
    rows += [(100 + i, f"https://copies.example/{i}", copied if i < 36 else other.format(i=i)) for i in range(40)]
    many = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(many).collect()}
    assert got[3] == "Story 3 in Sports" and got[4] == "Story 4 in brief"
    assert got[100] == "One story, copied\nto the end" and got[139] == "Other story 39"


def test_html_removes_what_few_pages_of_a_host_share(spark):
    page = "<body>{box}<div><p>Story {i} of its own</p></div></body>"
    box = "<div>Partner of the week</div>"
    rows = [(i, f"https://large.example/{i}", page.format(i=i, box=box if i < 6 else "")) for i in range(60)]
    rows += [(100 + i, f"https://little.example/{i}", page.format(i=i, box=box)) for i in range(7)]
    rows += [(200 + i, f"https://once.example/{i}", page.format(i=i, box=box if i < 2 else "")) for i in range(7)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 of its own" and got[104] == "Story 4 of its own" and got[200] == "Partner of the week\nStory 0 of its own"


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeilnorst"), rng.integers(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        ws = list(rng.choice(words, 40)) + (list(rng.choice(["zzgrubba", "zzgrubber", "zzgrubbing", "vilest"], int(rng.integers(1, 5)))) if bad else [])
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), "a"))
        if i % 2 == 0:
            labels.append((i, int(bad), 9))
    rows += [(1000, None, "a"), (1001, "", "a"), (None, "vilest zzgrubbest", "a"), (1, rows[1][1], "a")]
    lab = spark.createDataFrame(labels + [(None, 1, 9), (3, None, 9)], "doc_id long, toxic int, TOXIC int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, lab)
    got = toxicity.assess(docs, model).collect()
    assert len(got) == len(rows)
    assert sum(r["toxic"] != (r["doc_id"] % 5 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 600) <= 6
    assert [r["toxic"] for r in got if r["doc_id"] in (1000, 1001)] == [0, 0]
    assert list(model.thetas) == sorted(model.thetas)
    nothing = toxicity.fit(docs, lab.limit(0))
    assert {r["toxic"] for r in toxicity.assess(docs, nothing).collect()} == {0}
    assert toxicity.assess(docs.limit(0), model).count() == 0


def test_quality(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(800):
        good = i % 3 > 0
        n = int(rng.integers(5, 80))
        rows.append((i, " ".join(f"w{int(k)}" if good else "spam&&&" for k in rng.integers(0, 500, n)), "a"))
        labels.append((i, int(good)))
    rows += [(2000, None, "a"), (2001, "", "a"), (1, rows[1][1], "a"), (None, "some text", "a")]
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, quality int")
    got = [r.asDict() for r in quality.score(docs_of(spark, rows), lab).collect()]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in got)
    held = [r for r in got if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held if r["doc_id"] < 800) >= 0.97 * sum(r["doc_id"] < 800 for r in held)
    assert {r["score"] for r in quality.score(docs_of(spark, rows[:5]), lab.limit(0)).select("score").collect()} == {1.0}
    assert quality.score(docs_of(spark, rows).limit(0), lab).count() == 0
    assert len(quality.statistics(None)) == len(quality.statistics("a b\nc")) == quality.N_STATS


def test_isotonic_pools():
    at, levels = quality.pool(np.array([1.0, 1, 2, 1]), np.array([0.0, 0.8, 0.4, 1.0]), np.arange(4.0))
    assert levels.tolist() == sorted(levels) and len(levels) == 3


def test_substring(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdeilnorst"), rng.integers(2, 8)))
    text = lambda n: [word() for _ in range(n)]
    passage, fuzzy = text(70), text(80)
    variant = list(fuzzy)
    variant[20], variant[55:56] = "EDIT", []
    rows = [(i, " ".join([*text(60), *passage, *text(40)])) for i in range(12)]
    rows += [(50, " ".join([*text(30), *fuzzy])), (51, " ".join([*variant, *text(30)])), (52, " ".join(text(300))), (60, None), (61, ""), (None, " ".join(passage)), (62, "one two"), (63, "und " * 5000), (64, "line one\n" + " ".join(passage) + "\nline two")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, chains string")
    got = {r["doc_id"]: r for r in substring.repeated_passages(docs).collect()}
    whole = " ".join(passage)
    assert whole in got[0]["kept"] and not got[0]["passages"]
    for i in range(1, 12):
        assert [(p["start"], p["words"], p["of"]) for p in got[i]["passages"]] == [(60, 70, 0)] and whole not in got[i]["kept"] and got[i]["n_cut"] == 70
    assert got[51]["passages"][0]["of"] == 50 and got[51]["n_cut"] == 79
    for i in (50, 52, 60, 61, None, 62, 63):
        assert not got[i]["passages"] and got[i]["n_cut"] == 0
    assert got[64]["kept"] == "line one\nline two" and got[64]["chains"] == "clash"
    assert substring.repeated_passages(docs.limit(0)).count() == 0


def test_chains_follow_both_orders():
    xs, ys = [0, 10, 20, 30, 40], [100, 110, 5, 120, 130]
    assert substring.chains(xs, ys, 5, 0.1) == [[(0, 100), (10, 110), (30, 120), (40, 130)], [(20, 5)]]
    assert substring.chains([0, 500], [0, 500], 5, 0.01) == [[(0, 0)], [(500, 500)]]


def test_seeds_of_many_texts_are_those_of_every_window():
    rng = np.random.default_rng(11)
    texts = [None, "", "a", "a b c d e f", "one two " * 200] + [" ".join(rng.choice(list("abcdefgh"), int(n))) for n in rng.integers(0, 40, 300)]
    got = [[] for _ in texts]
    for some in substring.portions(texts):
        of, seeds, pos = substring.seeds_of(texts[some], 6, 8)
        for i, seed, at in zip(of.tolist(), seeds.tolist(), pos.tolist()):
            got[some.start + i].append((seed, at))
    for text, mine in zip(texts, got):
        h = substring.grams(substring.word_codes(words_of(text)), 6)
        if len(h) <= 8:
            wanted = [int(h.argmin())] if len(h) else []
        else:
            wanted = sorted({i for b in range(len(h) - 7) for i in range(b, b + 8) if h[i] == h[b : b + 8].min()})
        kept = []
        for i in wanted:
            if not kept or h[i] != h[kept[-1]] or i - kept[-1] >= 8:
                kept.append(i)
        assert mine == list(zip(h.view(np.int64)[kept].tolist(), kept))


def test_portions_cover_all_texts_in_order():
    texts = ["x" * n for n in (0, 10, substring.PORTION + 5, 3)] + [None]
    assert [(p.start, p.stop) for p in substring.portions(texts)] == [(0, 2), (2, 3), (3, 5)]
    assert list(substring.portions([])) == []


def test_common_words_are_longest_common_subsequences():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, m = rng.integers(1, 33, 2)
        equal = rng.random((n, m)) < rng.choice([0.0, 0.1, 0.5, 1.0])
        want = np.zeros((n + 1, m + 1), int)
        for i in range(n):
            for j in range(m):
                want[i + 1, j + 1] = want[i, j] + 1 if equal[i, j] else max(want[i, j + 1], want[i + 1, j])
        assert (substring.common_words(equal)[0] == want[1:, 1:]).all()


def test_substring_parts_passages_of_one_chain(spark):
    new = iter(range(100_000))
    fresh = lambda n: " ".join(f"w{next(new)}" for _ in range(n))
    one, two, short = fresh(50), fresh(50), fresh(10)
    rows = [(1, f"{fresh(20)} {one} {fresh(30)} {two} {fresh(20)}"), (2, f"{fresh(9)} {one} {fresh(30)} {two} {fresh(9)}")]
    rows += [(3, f"{(three := fresh(50))} {fresh(30)} {short}"), (4, f"{three} {fresh(30)} {short}")]
    got = {r["doc_id"]: [(p["start"], p["words"], p["of"]) for p in r["passages"]] for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(9, 50, 1), (89, 50, 1)], 3: [], 4: [(0, 50, 3)]}


def test_substring_finds_partners_behind_a_decoy(spark):
    new = iter(range(100_000))
    fresh = lambda n: [f"v{next(new)}" for _ in range(n)]
    passage = fresh(60)
    decoy = [w for i in range(0, 56, 5) for w in (*passage[i : i + 5], *fresh(60))]
    decoy += [w for i in range(56) for w in (*passage[i : i + 5], *fresh(60))]  # each single five-gram
    decoy += [w for i in range(52) for w in (*passage[i : i + 9], *fresh(60))]  # and every seed, nine words at a time
    rows = [(1, decoy), (2, fresh(20) + passage + fresh(20)), (3, fresh(30) + passage + fresh(10)), (4, passage)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r["doc_id"]: [(p["start"], p["words"], p["of"]) for p in r["passages"]] for r in substring.repeated_passages(docs).collect()}
    assert got[1] == got[2] == [] and got[3] == [(30, 60, 2)]
    assert (0, 60, 2) in got[4] and {p[:2] for p in got[4]} == {(0, 60)} and {p[2] for p in got[4]} <= {2, 3}


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 0.2, 16).astype("float32").tolist()) for i in range(300)]
    rows += [(300, rows[0][1]), (300, rows[1][1]), (301, None), (302, [None] * 16), (303, [float("nan")] * 16), (304, [float("inf")] * 16), (305, [0.0] * 16), (306, [0.5] * 3), (None, rows[2][1]), (350, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, Embedding string")
    got = defaultdict(list)
    monkeypatch.setattr(topk, "QUERY_BLOCKS", 2)
    for r in topk.top_k(df, "vec_id % 50 = 0", block_rows=64, query_rows=3).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    usable = [(i, np.floor(256 * np.array(v, "float64")).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    usable = [(i, np.pad(v, (0, 16 - len(v)))) for i, v in usable]
    want = defaultdict(list)
    for q, v in usable:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in usable if i != q)[:5]
            want[q] += [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items()}
    assert topk.top_k(df.limit(0), "vec_id % 50 = 0").count() == 0
    assert topk.top_k(df.where("vec_id = 0"), "vec_id % 50 = 0").count() == 0


def test_top_k_reads_only_part_of_the_postings():
    rng = np.random.default_rng(17)
    near = rng.normal(0, 40, (20, 48))
    values = np.floor(np.concatenate([near + rng.normal(0, 2, (20, 48)), rng.normal(0, 6, (2000, 48))])).astype(np.int64)
    queries = np.floor(near).astype(np.int64)
    index = topk.Index(np.arange(len(values)), values)
    got = defaultdict(list)
    for row, vec, score in index.top(np.full(20, -1), queries, 3):
        got[row].append((vec, score))
    for row in range(20):
        exact = values @ queries[row]
        order = np.lexsort((np.arange(len(values)), -exact))[:3]
        assert got[row] == [(int(i), int(exact[i])) for i in order]
    assert 0 < index.read < 0.6 * index.offered
    floor = np.full(20, 1e12)
    read = index.read
    assert not list(index.top(np.full(20, -1), queries, 3, floor)) and index.read == read


def test_packing_to_targets_equals_deficit_counters(spark):
    rng = np.random.default_rng(41)
    rows = [(i, " ".join(["token"] * int(rng.integers(5, 120))), "abc"[i % 3 if i % 7 else 0]) for i in range(400)]
    out = packing.pack(docs_of(spark, rows), public.path("byte_bpe_50k.json"), window=1, targets={"a": 1.0, "b": 3.0, "c": 1.0}).collect()
    sizes = {r["doc_id"]: r["doc_tokens"] for r in out}
    source = {i: s for i, _, s in rows}
    queues = {s: [i for i in sorted(sizes) if source[i] == s] for s in "abc"}
    deficit = dict.fromkeys("abc", 0.0)
    order = []
    while any(queues.values()):
        for s, share in (("a", 0.2), ("b", 0.6), ("c", 0.2)):
            deficit[s] += 2048 * share
            while queues[s] and sizes[queues[s][0]] <= deficit[s] + 1e-9:
                deficit[s] -= sizes[queues[s][0]]
                order.append(queues[s].pop(0))
    got = sorted((r for r in out if r["start"] == 0), key=lambda r: (r["sequence_id"], r["offset"]))
    assert [r["doc_id"] for r in got] == order
    with pytest.raises(ValueError):
        packing.pack(docs_of(spark, rows), public.path("byte_bpe_50k.json"), targets={"a": 0.0})


def test_clashing_columns_are_replaced_or_kept(spark):
    common = "a line that is in three documents"
    docs = spark.createDataFrame([(i, f"own {i}\n{common}", "X", 7, "k") for i in range(4)] + [(None, None, None, None, None)], "doc_id long, text string, TEXT string, n_words int, keep string")
    kept = linededup.with_kept(docs, linededup.keep_bitmaps(docs))
    assert kept.columns == ["doc_id", "text", "TEXT", "n_words", "keep", "n_lines", "n_dropped", "kept"] and kept.count() == 5
    cut = substring.repeated_passages(docs)
    assert cut.columns == ["doc_id", "text", "TEXT", "keep", "n_words", "n_cut", "passages", "kept"] and cut.count() == 5
    judged = toxicity.assess(docs, toxicity.OrdinalModel())
    assert judged.columns[:5] == docs.columns and judged.count() == 5
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == 5


def test_fingerprint_bits_by_plain_counting():
    import xxhash

    for text in ("", "one", "A b c d e f g h", "the quick brown fox " * 9):
        words = text.encode().lower().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want = sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.simhash(shingle_hashes(words_of(text), 4)) & (1 << 64) - 1 == want


def test_passages_against_brute_force_local_alignment(spark):
    """Recall of planted fuzzy passages: each must be found where its words match at 0.8 to 1."""
    rng = np.random.default_rng(43)
    new = iter(range(10**7))
    fresh = lambda n: [f"w{next(new)}" for _ in range(n)]
    rows, planted = [], {}
    for i in range(120):
        n, wrong = int(rng.integers(50, 90)), float(rng.choice([0, 0.05, 0.1, 0.15]))
        passage = fresh(n)
        copy = list(passage)
        for at in rng.choice(n, int(n * wrong), replace=False):
            copy[at : at + 1] = fresh(int(rng.integers(0, 3))) if rng.random() < 0.5 else fresh(1)
        rows.append((2 * i, " ".join(fresh(int(rng.integers(0, 60))) + passage + fresh(int(rng.integers(0, 60))))))
        rows.append((2 * i + 1, " ".join(fresh(int(rng.integers(0, 60))) + copy + fresh(int(rng.integers(0, 60))))))

    def best(a, b):
        """Words matched in the best common stretch, by the longest common subsequence of all words (they are unlike elsewhere)."""
        at = {w: j for j, w in enumerate(b)}
        runs = [(i, at[w], 1) for i, w in enumerate(a) if w in at]
        return substring.segments(runs, 45, 0.8)

    got = {r["doc_id"]: r["passages"] for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {j: best(b.split(), a.split()) for (_, a), (j, b) in zip(rows[::2], rows[1::2])}
    asked = [j for j, w in want.items() if w]
    found = [j for j in asked if any(p["of"] == j - 1 and p["matched"] >= 0.9 * want[j][0][4] for p in got[j])]
    assert len(asked) > 80 and len(found) >= 0.95 * len(asked)
    assert not any(got[i] for i, _ in rows[::2])


def test_substring_finds_passages_of_which_earlier_documents_hold_parts(spark):
    """Every seed of a passage is in four earlier documents that each hold 22 of its words; and passages of few different words."""
    new = iter(range(10**6))
    fresh = lambda n: [f"w{next(new)}" for _ in range(n)]
    passages = [fresh(60) for _ in range(40)]
    rows = [fresh(20) + p[a : a + 22] + fresh(20) for p in passages for a in (0, 13, 26, 38)]
    rows += [fresh(30) + p + fresh(20) for p in passages] + [fresh(10) + p + fresh(20) for p in passages]
    few = [["la"] * 60, ["yes", "no"] * 30]
    rows += [fresh(20) + p + fresh(5) for p in few for _ in range(2)]
    out = substring.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")).collect()
    got = {r["doc_id"]: [(p["start"], p["words"], p["of"]) for p in r["passages"]] for r in out}
    for i in range(40):
        assert got[200 + i] == [(10, 60, 160 + i)] and got[160 + i] == []
    assert [r["n_cut"] for r in sorted(out, key=lambda r: r["doc_id"])[240:]] == [0, 60, 0, 60]


def test_substring_recall_of_fuzzy_passages_with_many_holders(spark):
    """45 to 80 words, 3 to 20 holders, likeness 0.8 to 0.9 to the first holder, with an earlier document that holds a third of the passage."""
    rng = np.random.default_rng(47)
    new = iter(range(10**7))
    fresh = lambda n: [f"w{next(new)}" for _ in range(n)]
    decoys, firsts, copies = [], [], []
    for n in (45, 50, 60, 80):
        for likeness in (0.8, 0.85, 0.9):
            for holders in (3, 8, 20):
                passage = fresh(n)
                begin = int(rng.integers(0, n - n // 3))
                decoys.append(fresh(10) + passage[begin : begin + n // 3] + fresh(10))
                firsts.append(fresh(int(rng.integers(0, 40))) + passage + fresh(int(rng.integers(0, 40))))
                for _ in range(holders - 1):
                    copy = list(passage)
                    for at in 1 + rng.choice(n - 2, int(n * (1 - likeness) + 1e-9), replace=False):
                        copy[at] = fresh(1)[0]
                    before = int(rng.integers(0, 40))
                    copies.append((likeness, n, before, fresh(before) + copy + fresh(int(rng.integers(0, 40)))))
    rows = [*decoys, *firsts, *(c[3] for c in copies)]
    got = {r["doc_id"]: r["passages"] for r in substring.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")).collect()}
    found = defaultdict(list)
    for i, (likeness, n, before, _) in enumerate(copies, len(decoys) + len(firsts)):
        found[likeness, n].append(any(p["start"] <= before + 0.1 * n and p["start"] + p["words"] >= before + 0.9 * n for p in got[i]))
    shares = {k: sum(v) / len(v) for k, v in found.items()}
    assert sum(map(sum, found.values())) >= 0.97 * len(copies), shares
    assert min(shares.values()) >= 0.9, shares


def test_substring_compares_all_holders_of_a_seed(spark, monkeypatch):
    """Passages around a line that 150 earlier documents hold, unlike right beside it, so that nothing puts their holders side by side."""
    new = iter(range(10**6))
    fresh = lambda n: [f"u{next(new)}" for _ in range(n)]
    rows, copies = [], []
    for _ in range(4):
        line = fresh(13)
        rows += [fresh(30) + line + fresh(30) for _ in range(150)]
        before, after = fresh(20), fresh(20)
        changed = [fresh(1)[0] if i % 5 == 4 else w for i, w in enumerate(before)], [fresh(1)[0] if i % 5 == 0 else w for i, w in enumerate(after)]
        copies += [before + line + after + fresh(20), fresh(7) + changed[0] + line + changed[1]]
    rows += copies
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    for tile in (substring.TILE, 40):  # in tiles too
        monkeypatch.setattr(substring, "TILE", tile)
        got = {r["doc_id"]: r["passages"] for r in substring.repeated_passages(docs).collect()}
        assert {i: {p["of"] for p in found} for i, found in got.items() if found} == {601 + 2 * i: {600 + 2 * i} for i in range(4)}
        assert all(min(p["words"] for p in got[601 + 2 * i]) >= 45 for i in range(4))


def test_holders_compared_are_those_with_a_like_stretch(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(23)
    k, least = 2, 10
    near, far = substring.reach(k, least, 0.8)
    rows, n = [], 240
    base = rng.integers(1, 60, 2 * far + k)
    for i in range(n):
        words = np.where(rng.random(len(base)) < rng.choice([0.1, 0.3, 0.6]), rng.integers(60, 2000, len(base)), base)
        words[far : far + k] = base[far : far + k]
        words[: rng.integers(0, far)] = 0
        rows.append((int(i >= 40), i // 2, i % 2, 0, False, bool(rng.random() < 0.8), 0, 0, 0, words.astype("<u2")))
    names = ["seed", "doc", "pos", "prev", "joined", "open", "part", "low", "high"]
    table = pa.table({c: np.array([r[j] for r in rows]) for j, c in enumerate(names)} | {"words": [r[-1].tobytes() for r in rows]})
    want = set()
    for y in range(n):
        for x in range(y):
            if rows[y][5] and rows[x][0] == rows[y][0] and rows[x][1] < rows[y][1]:
                own, theirs = rows[y][-1][far - near : far + near + k], set(rows[x][-1].tolist())
                unlike = [0, *np.cumsum([1000 if w == 0 else w not in theirs for w in own.tolist()]).tolist()]
                if any(5 * (unlike[b] - unlike[a]) <= b - a for a in range(near + 1) for b in range(max(near + k, a + least), len(unlike))):
                    want.add((y, x))
    assert 100 < len(want) < 0.7 * n * n / 2
    for few in (0, 64, 1000):
        monkeypatch.setattr(substring, "FEW", few)
        c = substring._Compared(table, k, least, 0.8)
        assert {p for y, x in c.pairs() for p in zip(y.tolist(), x.tolist())} == want


def test_copies_of_a_context_meet_its_first_holder_alone(spark):
    rows = [(1, d, p, 0, False, is_open, w) for d, p, is_open, w in ((5, 0, False, b"a"), (6, 3, True, b"a"), (7, 0, False, b"a"), (5, 9, True, b"a"), (6, 8, True, b"b"), (6, 9, True, b"b"))]
    own, copies = substring.parted(spark.createDataFrame([(*r[:-1], bytearray(r[-1])) for r in rows], substring.CONTEXT))
    assert sorted((r["doc"], r["pos"]) for r in own.collect()) == [(5, 0), (5, 9), (6, 8), (6, 9)]
    assert [tuple(r) for r in copies.collect()] == [(1, 6, 3, 5, 0, False)]


def _compared(texts, k, least, pos):
    import pyarrow as pa

    codes = [substring.word_codes(words_of(t)) for t in texts]
    held = [[{"pos": p, "seed": int(substring.grams(c, k).view(np.int64)[p]), "open": True}] for c, p in zip(codes, pos)]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts, "held": held})
    table = pa.Table.from_batches(list(substring._contexts(k, substring.reach(k, least, 0.8)[1], least)(iter([batch]))))
    for c in ("part", "low", "high"):
        table = table.append_column(c, pa.array(np.zeros(len(texts), np.int32)))
    return substring._Compared(table, k, least, 0.8)


def test_holders_of_a_common_line_are_found_by_rare_words(monkeypatch):
    """Most holders share the line and frequent words alone, one in fifty a passage too: few pairs are compared, none is lost."""
    rng = np.random.default_rng(5)
    line, n = " ".join(f"l{i}" for i in range(14)), 1500
    fresh = lambda size: [f"w{rng.integers(1 << 40)}" if rng.random() < 0.6 else f"c{rng.integers(20)}" for _ in range(size)]
    after, texts = [], []
    for i in range(n):
        own = fresh(60)
        if i % 50 == 49:
            own = [w if j % 8 else f"v{i}" for j, w in enumerate(after[i - 37])]
        after.append(own)
        texts.append(" ".join([line, *own]))
    c = _compared(texts, 6, 45, [8] * n)
    compared = []
    monkeypatch.setattr(c, "like", lambda y, x, like=c.like: compared.append(len(y)) or like(y, x))
    got = {p for y, x in c.pairs(4) for p in zip(y.tolist(), x.tolist())}
    assert got == {(i, i - 37) for i in range(49, n, 50)}
    assert sum(compared) < 20 * n


def test_holders_in_order_stop_when_a_round_has_its_own():
    """Where common words suffice the first holders are given, as many as the round takes and whether there are more; all, if all are asked for."""
    rng = np.random.default_rng(6)
    texts = [" ".join(["the"] * 50 + [f"x{i}"] * int(rng.integers(1, 60))) for i in range(400)]
    c = _compared(texts, 6, 45, [20] * 400)
    whole = {y: xs for ys, xs_ in c.pairs() for y, xs in ((y, xs_[ys == y].tolist()) for y in np.unique(ys).tolist())}
    assert {y: len(xs) for y, xs in whole.items()} == {y: len(set(range(y)) & set(np.flatnonzero(c.first).tolist())) for y in range(1, 400)}
    some = {y: xs for ys, xs_ in c.pairs(4) for y, xs in ((y, xs_[ys == y].tolist()) for y in np.unique(ys).tolist())}
    assert all(xs == whole[y][: len(xs)] and len(xs) >= min(5, len(whole[y])) for y, xs in some.items()) and some.keys() == whole.keys()
    assert sum(map(len, some.values())) < 30 * 400


def test_repeated_words_count_as_often_as_both_have_them_on_a_side():
    few, many, after = ["the"] * 8, ["the"] * 60, [f"a{i}" for i in range(60)]
    texts = [[*few, *after], [*[f"b{i}" for i in range(30)], *few, *[f"b{i}" for i in range(30, 60)]], [*many, "end"], [*after, *many], [*["x"] * 30, *many[:45], *["y"] * 30], [*["x"] * 33, *many[:40], *["z"] * 33]]
    c = _compared([" ".join(w) for w in texts], 6, 45, [0, 30, 20, 80, 50, 50])
    assert {p for y, x in c.pairs() for p in zip(y.tolist(), x.tolist())} == {(3, 2), (4, 2), (4, 3), (5, 2), (5, 3), (5, 4)}


def _near_rows(texts, k, least, pos, likeness=0.8):
    import pyarrow as pa

    codes = [substring.word_codes(words_of(t)) for t in texts]
    held = [[{"pos": p, "seed": int(substring.grams(c, k).view(np.int64)[p]), "open": True}] for c, p in zip(codes, pos)]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts, "held": held})
    rows = pa.Table.from_batches(list(substring._contexts(k, substring.reach(k, least, likeness)[1], least)(iter([batch]))))
    for c in ("part", "low", "high"):
        rows = rows.append_column(c, pa.array(np.zeros(len(texts), np.int32)))
    found = substring._near(k, least, likeness, 0, 1 << 20)(iter(rows.combine_chunks().to_batches()))
    return {(d, o) for b in found for d, o in zip(b["doc"].to_pylist(), b["of"].to_pylist())}


def test_holders_with_too_few_words_between_matched_ends_are_left_out(monkeypatch):
    """A word said 38 times is no passage of 45, though 80 percent of 45 words match; unlike words around it don't make it one."""
    runs = [" ".join([f"a{i}"] * 40 + ["the"] * 38 + [f"b{i}"] * 40) for i in range(80)]
    runs += [" ".join([f"a{i}"] * 40 + ["the"] * 60 + [f"b{i}"] * 40) for i in range(80, 84)]  # with each other and not before
    for few in (0, 1000):
        monkeypatch.setattr(substring, "FEW", few)
        found, want = _near_rows(runs, 6, 45, [56] * 80 + [66] * 4), {(i, j) for i in range(80, 84) for j in range(80, i)}
        assert found >= want and len(found - want) < 0.05 * 80 * 79 / 2  # a word's code may be another's


def test_holders_with_a_passage_are_pairs_wherever_its_seed_is(monkeypatch):
    """Passages of 45 to 300 words with 15 percent changed, their ends the same: aligned, so compared too."""
    rng = np.random.default_rng(11)
    new = iter(range(10**6))
    fresh = lambda n: [f"u{next(new)}" for _ in range(n)]
    texts, pos, want = [], [], set()
    for i in range(60):
        size = int(rng.choice([45, 60, 120, 300]))
        at = int(rng.integers(0, size - 14))
        line, own = [f"l{j}" for j in range(14)], fresh(size)
        own[at : at + 14] = line
        copy = [w if abs(j - at - 7) <= 7 or j in (0, size - 1) or rng.random() < 0.85 else fresh(1)[0] for j, w in enumerate(own)]
        for words in (own, copy):
            before = int(rng.integers(0, 90))
            texts.append(" ".join(fresh(before) + words + fresh(int(rng.integers(0, 90)))))
            pos.append(before + at + 4)
        a, b = (substring.word_codes(words_of(t)) for t in texts[-2:])
        if any(x <= pos[-1] < y for x, y, *_ in substring.segments(substring.align(b, a, [pos[-1]], [pos[-2]], 6)[0], 45, 0.8)):
            want.add((2 * i + 1, 2 * i))
    assert len(want) > 40
    for few in (0, 1000):
        monkeypatch.setattr(substring, "FEW", few)
        assert _near_rows(texts, 6, 45, pos) == want


def test_links_of_a_seed_over_many_partitions(spark):
    """A line of 400 documents: its rows lie in several partitions and have one first holder; nothing goes to Python again for that."""
    line = " ".join(f"l{i}" for i in range(40))
    texts = [f"u{i} v{i} {line} w{i}" if i % 5 else line for i in range(400)]
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = substring.links(docs, 6, 4)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    places = {}
    for i, t in enumerate(texts):
        _, seeds, pos = substring.seeds_of([t], 6, 4)
        for s, p in zip(seeds.tolist(), pos.tolist()):
            places.setdefault(s, []).append((1000 - i, p))
    want = {(s, d, p, *min(own)) for s, own in places.items() for d, p in own if d != min(own)[0]}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 2000


def test_few_open_rows_meet_large_groups_without_copies_of_their_holders(spark, monkeypatch):
    """Twenty open rows and 400 holders in parts of 40: as many pairs as in one part, and no holder is sent twice."""
    rng = np.random.default_rng(3)
    k, least = 6, 45
    far = substring.reach(k, least, 0.8)[1]
    base = rng.integers(1, 60000, 2 * far + k)
    rows = []
    for i in range(400):
        words = np.where(rng.random(len(base)) < rng.choice([0.1, 0.6]), rng.integers(1, 60000, len(base)), base)
        words[far : far + k] = base[far : far + k]
        rows.append((1, i, 0, 0, False, i % 20 == 7, bytearray(words.astype("<u2").tobytes())))
    contexts = substring.stash(spark.createDataFrame(rows, substring.CONTEXT), "contexts")
    found, sent = {}, {}
    for tile in (6000, 40):
        monkeypatch.setattr(substring, "TILE", tile)
        found[tile] = {(r["doc"], r["of"]) for r in substring.like_holders(contexts, k, least, 0.8, 0, 1000).collect()}
        with monkeypatch.context() as m:  # what is dealt out, instead of the pairs
            m.setattr(substring, "_near", lambda *a: lambda batches: (b.select(["seed", "doc", "pos", "doc", "pos", "open"]).rename_columns(["seed", "doc", "pos", "of", "at", "more"]) for b in batches))
            sent[tile] = substring.like_holders(contexts, k, least, 0.8, 0, 1000).count()
    assert found[40] == found[6000] and len(found[40]) > 500
    assert sent == {6000: 400, 40: 400 + 20 * 9}


def test_shuffle_files_and_scratch_tables_go_when_nothing_reads_them(spark, tmp_path, monkeypatch):
    """The largest tables of the first round aren't there when pairs are written, nor are they kept to its end."""
    import os

    there, real = {}, substring.stash

    def stash(df, name="t", swept=True):
        out = real(df, name, swept)
        tables[name] = out.stashed_at.removeprefix("file://").removeprefix("file:")
        there[name] = {n for n, path in tables.items() if os.path.isdir(path)}
        return out

    tables = {}
    monkeypatch.setattr(substring, "stash", stash)
    line = " ".join(f"l{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"{line} " + " ".join(f"u{i % 7}x{j}" if j % 9 else f"v{i}" for j in range(60))) for i in range(40)], "doc_id long, text string")
    before = spark.conf.get(scratch.CLEANUP, None)
    assert substring.find_passages(docs, 6, 4, 0.1, 45, 0.8).count() > 0
    assert not {"links", "left", "places"} & there["pairs"] and "distinct" in there["pairs"]
    assert spark.conf.get(scratch.CLEANUP, None) == before
