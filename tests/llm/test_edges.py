"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import exact_dedup, html_extract, jaccard, langid, packing, pii, sentencepiece_scan, substring, topk, toxicity
from tidegauge.llm.queries import vocabulary

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS[i * 7 % 20] + str(i % 97) for i in range(20_000))
RNG = np.random.default_rng(0)


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[rng.integers(20)]}{rng.integers(60)}" for _ in range(n))


BASE = prose(120, 1)
NEAR = BASE.split()
NEAR[60] = "changed"
DOCS = [
    (0, None), (1, ""), (2, "  \t\n"), (3, "one two"), (4, "ONE two"), (5, "one  two"), (6, BASE), (7, BASE.upper()), (8, " ".join(NEAR)), (9, prose(40, 2) + "\n" + BASE),
    (10, LONG), (11, LONG), (12, prose(300, 3)), (12, prose(300, 3)), (13, "be " * 400), (14, "É é ▁ 日本語 😀 mail a.b@c.de +1 (988) 555-2485 9.9.9.9 4111 1111 1111 1111"), (None, BASE), (None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls string, fp int, digest string, kept int, all_spans string, rank int, ids string, toxic int, bucket int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, "x", 1, "d", 1, "y", 1, "z", 1, 0) for i, t in DOCS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs, support=0.2).collect()
    groups = defaultdict(list)
    for i, t in DOCS:
        groups[hashlib.sha256(ascii_lower(t).encode()).hexdigest()].append(i)
    want = Counter()
    for h, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, h) for i in ids)
    assert Counter(map(tuple, got)) == want
    assert exact_dedup.exact_dedup(none).count() == 0
    assert set(exact_dedup.keep_one(docs).columns) == set(docs.columns)


def brute_removed():
    first = {}
    for i, t in DOCS:
        w = words(t)
        for k in range(len(w) - 12):
            if i is not None:
                g = tuple(w[k : k + 13])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in DOCS:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return Counter(out)


@pytest.mark.parametrize("batch", [300, 12 << 20])
def test_substring_dedup(docs, none, batch, monkeypatch):
    monkeypatch.setattr(substring, "BATCH_BYTES", batch)
    if batch == 300:  # every other cell of runs is hot
        monkeypatch.setattr(substring, "hot_runs", lambda *_: np.arange(1 << substring.HOT_BITS) % 2 == 0)
    assert Counter(map(tuple, substring.substring_dedup(docs, buckets=5).collect())) == brute_removed()
    assert substring.substring_dedup(none).count() == 0


def windows_of(texts):
    raw = b" ".join(texts)
    words = substring.Words(raw)
    doc = np.repeat(np.arange(len(texts)), [len(t.split()) for t in texts])
    at = np.flatnonzero(doc[:-12] == doc[12:])
    return words, doc[at], at, words.starts[at], words.ends[at + 12], raw


def test_equal_hashes_are_told_apart():
    a, b = b" ".join(b"a%d" % i for i in range(13)), b" ".join(b"b%d" % i for i in range(13))
    _, doc, *rest = windows_of([a, b, a])
    assert substring.losers(np.zeros(3, np.uint64), doc, *rest).tolist() == [False, False, True]


def test_hashes_of_runs_do_not_depend_on_place():
    rng = np.random.default_rng(5)
    texts = [b" ".join(b"w%d" % i for i in rng.integers(0, 12, 3000)) for _ in range(4)] + [b"x " * 5000 + b"y"]
    words, *_ = windows_of(texts)
    flat = b" ".join(texts).split()
    for n in (1, 3, 13):
        seen = {}
        for i, h in enumerate(words.runs(n).tolist()):
            assert seen.setdefault(tuple(flat[i : i + n]), h) == h
        assert len(set(seen.values())) == len(seen)
    runs = words.runs(3)
    assert words.minimisers().tolist() == [runs[i : i + 11].min() for i in range(len(flat) - 12)]


def sets_of(rows):
    out = []
    for i, t in rows:
        w = words(ascii_lower(t))
        out.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    return out


def brute_components(rows):
    sets = sets_of(rows)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i), d)) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("chunk", [300, 1_500_000])
def test_jaccard_join(docs, none, chunk, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_TOKENS", chunk)
    assert Counter(map(tuple, jaccard.jaccard_join(docs).collect())) == brute_components(DOCS)
    assert jaccard.jaccard_join(none).count() == 0


def test_jaccard_join_of_a_chain_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_TOKENS", 400)
    rows, now = [], prose(100, 9).split()
    for i in range(30):
        now = [*now]
        now[(i * 13) % 100] = f"new{i}"
        rows.append((100 - i, " ".join(now)))
    rows += [(200 + i, prose(80, 50 + i)) for i in range(20)]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == brute_components(rows)


def test_tree_links_equal_all_pairs():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 60, 60).astype(np.uint64)) for _ in range(6)]
    sets = []
    for i in range(120):
        s = base[i % 6].copy()
        drop = rng.integers(0, 22)
        sets.append(np.unique(np.concatenate([s[drop:], rng.integers(0, 1 << 60, int(rng.integers(0, 12))).astype(np.uint64)])))
    got = jaccard.tree_links(sets)
    root = list(range(120))
    for a in range(120):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert got.tolist() == root


def test_topk(spark):
    nan = float("nan")
    rows = [(i, RNG.normal(size=6).round(2).tolist()) for i in range(0, 130)] + [(130, None), (131, [1.0, None]), (132, [nan]), (133, []), (134, [1.0]), (None, [1.0])]
    rows += [(i, rows[3][1]) for i in range(140, 150)] + [(20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(3)
    got = sorted(map(tuple, topk.exact_topk(df, F.col("vec_id") % 10 == 0).collect()))
    valid = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in valid:
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in valid if i != q)
            want += [(q, s, i) for s, i in scores]
    found = defaultdict(list)
    for q, r, i, s in got:
        found[q].append((r, i, s))
    for q, v in {q: v for q, v in valid if q % 10 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in valid if i != q)
        want = [(-s, i) for s, i in scores][:5]
        assert [(s, i) for _, i, s in found[q]] == want
    assert topk.exact_topk(df.limit(0), F.lit(True)).count() == 0


def test_topk_in_blocks_and_groups(spark, monkeypatch):
    """Several blocks of queries and groups of candidates give the rows of one."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(300)] + [(10, [1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = sorted(map(tuple, topk.exact_topk(df, F.col("vec_id") % 10 == 0).collect()))
    monkeypatch.setattr(topk, "GROUP_ROWS", 16)
    monkeypatch.setattr(topk, "QUERIES_AT_ONCE", 4)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, topk.exact_topk(df, F.col("vec_id") % 10 == 0).collect())) == whole
    ints = [(i, [int(256 * x) for x in v]) for i, v in rows]
    for q, v in ints[20:60:10]:
        want = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ints if i != q)[:5]
        assert [(-s, i) for a, _, i, s in whole if a == q] == want


def test_scan_in_levels_equals_one_fold(spark, monkeypatch):
    monkeypatch.setattr(sentencepiece_scan, "FANOUT", 3)
    rng = np.random.default_rng(7)
    all_ = {fp: [rng.normal(size=(4, 4)) for _ in range(n)] for fp, n in ((1, 1), (2, 3), (3, 4), (4, 29))}
    df = spark.createDataFrame([(fp, c, m.tobytes()) for fp, ms in all_.items() for c, m in enumerate(ms)], "fp long, c long, m binary")
    got = {(r["fp"], r["c"]): (r["entry"], r["leave"]) for r in sentencepiece_scan._bounds(df, 4, 29).collect()}
    assert got == {(fp, c): x for fp, ms in all_.items() for c, x in enumerate(sentencepiece_scan.fold(ms))}


def test_sparse_accumulation():
    q, c = RNG.integers(-3, 3, (7, 5)) * (RNG.random((7, 5)) < 0.4), RNG.integers(-3, 3, (9, 5)) * (RNG.random((9, 5)) < 0.4)
    assert (topk.accumulate(q, c) == q @ c.T).all()


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    want = Counter()
    for i, t in DOCS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[(i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = packing.best_fit_pack(docs, vocabulary()).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.best_fit_pack(none, vocabulary()).count() == 0


def test_packing_plan_is_tight():
    counts = Counter(np.clip(np.random.default_rng(0).lognormal(6, 1.2, 20_000).astype(int), 1, 2048).tolist())
    plan = packing.plan_counts(counts)
    used = Counter()
    for parts, n in plan:
        assert sum(parts) <= 2048 and n > 0
        for p in parts:
            used[p] += n
    assert used == counts
    least = -(-sum(k * n for k, n in counts.items()) // 2048)
    assert sum(n for _, n in plan) <= 1.002 * least


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    out = []
    for k, (name, rx) in enumerate(PII):
        for m in re.finditer(rx, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{PII[k][0]}:{s}:{e}" for s, k, e in sorted(out))


HARD = ["a@b.c_d@e.f x@y", "300.1.1.1.1.1.1.1 0001.2.3.4 1.2.3.4.5.6.7.8.9", "1" * 30_000, "a" * 50_000 + "@b.co", "+" * 500 + "1 " * 100, "1." * 9_000,
        "4111111111111111 4111111111111111", "@@a@b.c@d.e ", "%+-@a.b-c.d_e+f@g.h", "12 4111 1111 1111 1111", "+12 345 678 901 2345 67890"]


def test_pii_base_spans(docs, none, spark):
    got = pii.find_pii(docs).collect()
    plain = lambda s: ",".join(x for x in s.split(",") if not x.startswith("id:"))
    assert Counter((r["doc_id"], plain(r["spans"])) for r in got) == Counter((i, brute_pii(t)) for i, t in DOCS)
    hard = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for r in pii.find_pii(hard).collect():
        want = brute_pii(HARD[r["doc_id"]])
        assert plain(r["spans"]) == want
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [want.count(k + ":") for k, _ in PII]
    assert pii.find_pii(none).count() == 0


def test_pii_patterns_find_new_identifiers(spark):
    rows = [(i, f"call Tel: +1 (988) 555-24{i:02d} now and Tel: X-{i}9Z-22 end") for i in range(10)] + [(50, "the Version 2.0.1 of the thing"), (51, "the +1 (988) 555-2499 is the one")]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3] == "phone:10:27,id:41:49"
    assert got[50] == "" and got[51] == "phone:4:21"


def test_pii_new_identifiers_induce_patterns(spark):
    tel = [f"call tel: +1 (988) 555-24{i:02d} today" for i in range(8)] + [f"call tel: X-{i}9Z today" for i in range(3)]
    rows = list(enumerate([*tel, *[f"his member-no: X-{i}9Z stands" for i in range(3)], "her member-no: M-77Q stands", "a room B-12C here"]))
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[8] == "id:10:15" and got[11] == "id:15:20"
    assert got[14] == "id:15:20"  # known only by the pattern that X-09Z and its like induced
    assert got[15] == ""


def test_pii_mask(docs):
    got = {r["doc_id"]: r for r in pii.mask(docs).collect()}
    assert got[14]["text"] == "É é ▁ 日本語 😀 mail [EMAIL] +1 (988) 555-2485 [IP] 4111 1111 1111 1111"
    assert got[0]["text"] is None and got[10]["text"] == LONG and got[6]["all_spans"] == "y"


def test_language_id(spark, docs, none):
    en, fr = "the of and with that this there which".split(), "le la des une avec dans pour quelque".split()
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(en if i % 2 else fr, 30)), "en" if i % 2 else "fr") for i in range(300)]
    rows += [(900, None, "en"), (901, "123 !?", "en"), (902, "the of that", None), (903, "L" * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(df, F.col("doc_id") % 3 != 1, F.col("doc_id") % 3 == 1).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang in rows[:300] if i % 3 == 1]
    assert np.mean(right) > 0.98
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(none, F.lit(True), F.lit(False)).count() == 0
    assert langid.identify(docs, F.lit(True), F.lit(False)).count() == len(DOCS)


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(2)
    clean = [f"{a}{b}" for a in ("ta", "re", "lo", "mi", "se") for b in ("ning", "ver", "dal", "pos", "rim")]
    bad = ["stupid", "idiot", "worthless"]
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(clean, 25))
        if i % 4 == 0:
            w[5] = bad[i // 4 % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, "taning i d i o t lover"), (1001, "taning st-up-id lover"), (1002, "you idxiot rever"), (1003, None), (1004, ""), (1005, "dalning " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(1, 1, None), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.detect(df, marks, F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 0).collect()}
    held = [got[i]["predicted"] == t for i, _, t in labels if i % 5 == 0]
    assert np.mean(held) > 0.97
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, 1005)] == [1, 1, 1, 0, 0, 0]
    assert toxicity.detect(none, marks, F.lit(True), F.lit(False)).count() == 0
    assert {r["score"] for r in toxicity.detect(docs, marks.limit(0), F.lit(True), F.lit(False)).collect()} == {0.0}


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header>Site</header><nav><a>{0}</a></nav>
<div class="cookie-notice">ok?</div><div id="content"><p>Text {0} &amp; more<br>and  on<p>Second <b>part {0}</b></p><p>Share this page</p><table><tr><td>cell {0}</td></tr></table></div>
<aside>see {0}</aside><section class="comments"><p>first! {0}</p></section><form><input><p>mail</p></form><footer>&copy; {0}</footer></body></html>"""


def test_html(spark, none):
    rows = [(i, f"https://h.example/{i}", PAGE.format(f"n{i}")) for i in range(12)]
    rows += [(50, None, None), (51, "nonsense", ""), (52, "http://x.y/", "<article><h1>A</h1><p>b<p>c &lt;d"), (53, "http://x.y/2", "plain & simple"), (54, "http://z/", "<p>" * 3000 + "deep"), (54, "http://z/", "<p>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("root", F.lit(2))
    got = defaultdict(list)
    for r in html_extract.extract(df).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[3] == ["Text n3 & more and on\nSecond part n3\ncell n3"]
    assert (got[50], got[51], got[52], got[53], got[54]) == ([""], [""], ["A\nb\nc <d"], ["plain & simple"], ["deep", "deep"])
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_root_holds_every_varying_slot(spark):
    """A quarter of the text beside the story, and nearly all of it on one page, stays."""
    page = "<body><div class='top'>Our site</div><section class='intro'><p>{1}</p></section><div class='story'><p>{0}</p><p>more {0}</p></div></body>"
    rows = [(i, f"http://h/{i}", page.format(f"story{i} " * 30, f"intro{i} " * 15)) for i in range(12)]
    rows.append((12, "http://h/12", page.format("short", "the main part " * 40)))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(f"intro{i} intro{i}" in got[i] and f"story{i}" in got[i] and "Our site" not in got[i] for i in range(12))
    assert got[12].startswith("the main part the main part")


def test_html_marks_do_not_empty_pages(spark):
    forms = {
        "body": "<body class='has-sidebar'><div class='sidebar-left'>side {0}</div><article>{1}</article></body>",
        "wrap": "<body><div class='elementor-widget'><main>{1}</main><section class='comments'><article>c {0}</article></section></div></body>",
        "post": "<body><article class='post comments-open'>{1}<div class='related'>other {0}</div></article></body>",
        "board": "<body><div class='top'>date {0}</div><div id='notice-board'>{1}</div><div class='comments'>c {0}</div></body>",
        "only": "<body><div id='notice-board'>{1}</div></body>",
    }
    rows = [(f"{k}{i}", f"http://{k}/{i}", f.format(i, f"<p>words of {k} {i}</p><p>and then number {i}</p>")) for k, f in forms.items() for i in range(10)]
    df = spark.createDataFrame(rows, "page string, url string, html string").withColumn("page_id", F.monotonically_increasing_id())
    got = {r["url"]: r["text"] for r in html_extract.extract(df).collect()}
    for k in forms:
        for i in range(10):
            want = f"words of {k} {i}\nand then number {i}"
            assert got[f"http://{k}/{i}"] == (f"date {i}\n{want}" if k == "board" else want)
    assert html_extract.extract_text("<article></article><div class='ad'>buy</div>", None, frozenset(), set()) == ""
    assert html_extract.extract_text("<div></div><div class='notice'>the story</div>", None, frozenset(), set()) == "the story"


def test_html_template_of_few_pages_and_of_near_copies(spark):
    page = "<body><div class='top'>Welcome to our site</div><div class='text'><p>{0}</p><p>{1}</p></div></body>"
    rows = [(i, f"http://few/{i}", page.format(f"story {i} " * 20, f"end {i} " * 9)) for i in range(2)]
    rows += [(10 + i, f"http://near/{i}", page.format("the same story " * 40, f"on day {i}")) for i in range(12)]
    rows += [(30 + i, f"http://near/x{i}", page.format(f"story {i} " * 20, f"end {i} " * 9)) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert not any("Welcome" in t for t in got.values())
    assert got[0].startswith("story 0") and got[31].startswith("story 1")
    assert all(got[10 + i].startswith("the same story") and got[10 + i].endswith(f"on day {i}") for i in range(12))


def tree_of(label, *kids):
    node = html_extract.Node(label, 0, 1)
    node.children = list(kids)
    return node


def test_simple_tree_matching():
    t = tree_of
    a, b = t("body", t("nav"), t("main", t("p")), t("footer")), t("body", t("main", t("p"), t("ul")), t("footer"))
    assert html_extract.match(a, b) == 4
    merged = html_extract.merge(a, b)
    assert [c.label for c in merged.children] == ["nav", "main", "footer"] and [c.label for c in merged.children[1].children] == ["p", "ul"]
    merged.children[1].place = 7
    assert html_extract.content_root(merged) == 7


def test_tree_matching_equals_all_alignments():
    rng = np.random.default_rng(8)

    def random_tree(depth):
        return tree_of("abc"[rng.integers(3)], *[random_tree(depth - 1) for _ in range(rng.integers(0, 4))] if depth else [])

    def brute(x, y):
        if x.label != y.label:
            return 0

        def best(i, j):
            if i == len(x.children) or j == len(y.children):
                return 0
            return max(best(i + 1, j), best(i, j + 1), brute(x.children[i], y.children[j]) + best(i + 1, j + 1))

        return 1 + best(0, 0)

    for _ in range(60):
        a, b = random_tree(3), random_tree(3)
        assert html_extract.match(a, b) == brute(a, b)
        if a.label == b.label:  # a union holds both trees, and what they share once
            merged = html_extract.merge(a, b)
            assert len(merged.walk()) == len(a.walk()) + len(b.walk()) - html_extract.match(a, b)
            assert html_extract.match(merged, a) == len(a.walk())


def test_html_of_any_depth_and_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "MERGED_AT_ONCE", 3)
    rows = [(i, "http://deep/", "<div>" * 5000 + f"deep {i % 2}") for i in range(4)]
    rows += [(10 + i, "http://many/", "<div class='menu-x'>same</div>" + f"<section class='k{'abcdefghijkl'[i]}'><p>text {i} of its own</p></section>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == ["deep 0", "deep 1"] * 2
    assert [got[10 + i] for i in range(12)] == [f"text {i} of its own" for i in range(12)]


def test_html_wrapper_decides_where_no_name_tells(spark):
    page = "<body><div><ul><li>Home</li><li>All news</li></ul></div><div><h1>{0}</h1><p>{1}</p></div><div><p>Imprint and terms</p></div></body>"
    rows = [(i, "http://plain/", page.format(f"Title {i}", f"words {i} " * 9)) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\n" + " ".join([f"words {i}"] * 9) for i in range(9))
    assert "Imprint" in html_extract.extract_text(rows[0][2], None, frozenset(), set())


@pytest.mark.parametrize("giant", [50, 10**9])
def test_sentencepiece(docs, none, giant, monkeypatch):
    monkeypatch.setattr(sentencepiece_scan, "FANOUT", 3)
    monkeypatch.setattr(sentencepiece_scan, "CHUNK", 500)
    path = vocabulary("piece_bpe_32k.model")
    got = sentencepiece_scan.decode(sentencepiece_scan.encode(docs, path, giant), path).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in got) == Counter((i, t or "") for i, t in DOCS)
    pieces = sentencepiece_scan.Pieces.of(path)
    score = {i: s for s, i in pieces.score.values()}
    known = lambda ids: [i for i in ids if i in score]
    for r in got:
        if r["text"] and len(r["text"]) < 5000:
            ids, want = np.frombuffer(r["ids"], "<u4").tolist(), pieces.path(" " + r["text"])
            assert sum(score[i] for i in known(ids)) == sum(score[i] for i in known(want)) and len(ids) - len(known(ids)) == len(want) - len(known(want))
    assert sentencepiece_scan.encode(none, path).count() == 0


def test_every_cut_of_a_short_text_is_worse():
    pieces = sentencepiece_scan.Pieces.of(vocabulary("piece_bpe_32k.model"))
    score = {i: s for s, i in pieces.score.values()}
    text = " hello ab"

    def best(at):
        return 0.0 if at == len(text) else max(s + best(at + n) for n, s in pieces.steps(text, at))

    assert sum(score.get(i, pieces.fallback) for i in pieces.path(text)) == best(0)


def test_compiled_words_equal_the_programme():
    pieces = sentencepiece_scan.Pieces.of(vocabulary("piece_bpe_32k.model"))
    for unit in [" hello", "   x", " wörld,", " 日本語", " 😀é▁", "ab", " ", " " + "z" * 40, " a\nb\tc", " 😀😀x日"]:
        assert pieces.word(unit) == np.array(pieces.path(unit), "<u4").tobytes()
