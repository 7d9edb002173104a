"""Personal data by bootstrapped contextual extraction; DataFrame operations only.

Seeds are the spans of four fixed kinds (e-mail, IP address, payment card, phone number). The
word before a seed, the two words before it and the word after it induce lexical patterns.
Identifier-like words (with a digit or an @) and the patterns around them form a graph, scored in
rounds: a pattern is worth the confidence of what it introduces over *all* its occurrences in the
corpus, so an everyday word that seeds happen to follow is worth next to nothing; an identifier is
worth the noisy-or of its patterns. Identifiers trusted so far induce patterns as seeds do, until a
round adds no pattern. Identifiers introduced by a pattern of high worth are reported as kind
``id``. Seeds stay.

Positions are code points, found by cutting the text at the matches and adding up lengths. The
expressions are written with possessive quantifiers and look-behinds that leave the matches as
they are but keep matching linear and stack-free on texts of any length.

Defined cases: null text is empty; no spans give an empty string and the digest of one; repeated
rows each get the same spans; a row without an id is treated like any other; an empty table
gives an empty result; further columns are ignored, and ``mask`` passes them through whatever their
names; matches in very long texts are located in parts, in time linear in their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage

ROUNDS = 3  # at least; then until no pattern is added
MIN_SEEDS = 3  # distinct seeds or trusted identifiers that must follow a pattern
STEP = 256  # matches
BROADCAST_PATTERNS = 100_000  # of at most 66 characters: 20 MB
SHORTEST = 4  # characters of a new identifier
WORTH = 0.5  # of a pattern, to introduce new identifiers
KINDS = ["email", "ip", "card", "phone", "id"]

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IDENTIFIER = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
SPANS = "array<struct<s:int,e:int,t:string>>"


def _matches(text: Column, regex: str) -> Column:
    """Start, end (exclusive) and string of each match, in code points."""
    zipped = F.arrays_zip(F.split(text, regex, -1).alias("p"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"))
    zipped = F.filter(zipped, lambda x: x["m"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("t")))).alias("spans"))

    def located(found: Column, at: Column) -> Column:
        return F.aggregate(found, F.struct(at.alias("at"), F.array().cast(SPANS).alias("spans")), step)["spans"]

    def in_parts(found: Column) -> Column:
        """Many matches, STEP at a time: appending to an array copies it, so none may grow long."""
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / STEP).cast("int")), lambda i: F.slice(found, i * STEP + 1, STEP))
        width = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + F.length(x["p"]) + F.length(x["m"]))

        def starts(parts: Column) -> Column:
            more = lambda acc, part: F.concat(acc, F.array(F.element_at(acc, -1) + width(part)))
            return F.zip_with(parts, F.slice(F.aggregate(parts, F.array(F.lit(0)), more), 1, F.size(parts)), located)

        return F.flatten(_once(parts, starts))

    return _once(zipped, lambda found: F.when(F.size(found) <= STEP, located(found, F.lit(0))).otherwise(in_parts(found)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _kinds(text: Column) -> dict[str, Column]:
    none = F.array().cast(SPANS)
    digits = lambda x: F.regexp_replace(x["t"], "[^0-9]", "")
    checks = {
        "email": (EMAIL, F.contains(text, F.lit("@")), None),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]"), lambda x: x["t"].rlike(rf"^{PART}(?:\.{PART}){{3}}$")),
        "card": (CARD, text.rlike(CARD), lambda x: F.call_function("luhn_check", digits(x))),
        "phone": (PHONE, F.contains(text, F.lit("+")), lambda x: F.length(digits(x)).between(10, 15)),
    }
    out = {}
    for kind, (regex, likely, valid) in checks.items():
        found = _matches(text, regex)
        out[kind] = F.when(likely, F.filter(found, valid) if valid else found).otherwise(none)
    return out


def _listed(spans: dict[str, str]) -> Column:
    """Spans of all kinds by start, then kind as listed."""

    def ranked(k: str, c: str) -> Column:
        return F.transform(F.col(c), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(k)).alias("k"), x["e"].alias("e")))

    return F.array_sort(F.concat(*[ranked(k, c) for k, c in spans.items()]))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _candidates(text: Column) -> Column:
    """Identifier-like words with the patterns around them: words before and a blank, or a blank and the word after."""
    found = F.when(text.rlike("[0-9@]"), _matches(text, IDENTIFIER)).otherwise(F.array().cast(SPANS))

    def with_context(x: Column) -> Column:
        before = F.substring(text, F.greatest(x["s"] - 79, F.lit(1)), F.least(x["s"], F.lit(80)))
        after = F.substring(text, x["e"] + 1, F.lit(48))
        one, two = F.regexp_extract(before, r"(?:^|\s)(\S{1,32})\s+$", 1), F.regexp_extract(before, r"(?:^|\s)(\S{1,32}\s+\S{1,32})\s+$", 1)
        then = F.regexp_extract(after, r"^\s+(\S{1,32})(?:\s|$)", 1)
        blank, words = F.lit(" "), lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
        around = F.array(F.concat(words(one), blank), F.concat(words(two), blank), F.concat(blank, words(then)))
        core = F.regexp_extract(x["t"], r"^(.*?)[.,;:!?\"')\]]*$", 1)
        return F.struct(
            x["s"].alias("s"),
            (x["s"] + F.length(core)).alias("e"),
            F.lower(core).alias("t"),
            F.filter(around, lambda w: (w != " ") & ~w.rlike("[0-9@]")).alias("ws"),
        )

    return F.transform(found, with_context)


def _occurrences(words: Column) -> Column:
    """Every place of a text where each pattern could stand."""
    blank = F.lit(" ")

    def places(ws: Column) -> Column:
        two = F.zip_with(ws, F.slice(ws, 2, F.size(ws)), lambda a, b: F.concat(a, blank, b, blank))
        return F.concat(F.transform(ws, lambda w: F.concat(w, blank)), F.filter(two, lambda w: w.isNotNull()), F.transform(ws, lambda w: F.concat(blank, w)))

    return _once(words, places)


def _patterns(edges: DataFrame, words: DataFrame) -> DataFrame:
    """Score the pattern-instance graph in rounds, each with the patterns that trusted identifiers induce; the patterns worth using."""
    every = stage(edges.groupBy("w", "t").agg(F.count(F.lit(1)).alias("hits"), F.max("seed").alias("seed")), "pii-graph")
    counts = trust = None
    last, rounds = -1, 0
    while True:
        known = every.withColumn("found", F.lit(0.0)) if trust is None else every.join(trust, "t", "left")
        known = known.withColumn("trust", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("found", F.lit(0.0))))
        induced = known.groupBy("w").agg(F.count_if(F.col("trust") >= WORTH).alias("seeds")).where(F.col("seeds") >= MIN_SEEDS).select("w")
        added = stage(induced if counts is None else induced.join(counts, "w", "left_anti"), "pii-induced")
        if counts is None or not added.isEmpty():
            few = added.count() <= BROADCAST_PATTERNS
            mine = words.join(F.broadcast(added) if few else added, "w", "left_semi")  # before anything moves
            counted = stage(mine.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "pii-patterns")
            counts = counted if counts is None else counts.unionByName(counted)
        worth = known.join(counts, "w").groupBy("w").agg((F.sum(F.col("trust") * F.col("hits")) / F.max("n")).alias("worth"))
        worth = stage(worth.where(F.col("worth") >= WORTH), "pii-worth")
        n, rounds = worth.count(), rounds + 1
        if not n or (n == last and rounds >= ROUNDS):
            return worth.select("w")
        last = n
        noisy = every.join(worth, "w").groupBy("t").agg(F.sum(F.ln(1 - F.least("worth", F.lit(0.99)))).alias("miss"))
        trust = stage(noisy.select("t", (1 - F.exp("miss")).alias("found")), "pii-trust")


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts by kind, base_sha256, spans; and fp and all_spans to mask by."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").alias("doc_id"), text.alias("text"))
    base = {k: f"_{k}" for k in KINDS[:4]}
    found = stage(
        texts.select("doc_id", F.xxhash64("text").alias("fp"), *[c.alias(f"_{k}") for k, c in _kinds(F.col("text")).items()], _candidates(F.col("text")).alias("cand")),
        "pii-found",
    )
    listed = _listed(base)
    near = found.where(F.size("cand") > 0).select("doc_id", "fp", F.concat(*base.values()).alias("base"), F.explode("cand").alias("c"))
    covered = F.filter("base", lambda b: (b["s"] < F.col("c.e")) & (F.col("c.s") < b["e"]))
    edges = near.select("doc_id", "fp", F.explode("c.ws").alias("w"), "c.s", "c.e", "c.t", F.get(covered, F.lit(0)).alias("b"))
    edges = edges.where(F.col("b").isNotNull() | (F.length("t") >= SHORTEST))
    edges = edges.withColumns({"seed": F.col("b").isNotNull(), "t": F.coalesce(F.lower("b.t"), "t")}).drop("b")
    words = texts.select(F.explode(_occurrences(F.split(F.lower("text"), r"\s+"))).alias("w"))
    new = edges.where(~F.col("seed")).join(_patterns(edges, words), "w", "left_semi")
    new = new.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("s", "e", "t")).cast(SPANS).alias("_id"))
    new = new.select(F.col("doc_id").alias("id2"), F.col("fp").alias("fp2"), "_id")
    every = found.drop("cand").join(new, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("fp") == F.col("fp2")), "left")
    every = every.withColumn("_id", F.coalesce("_id", F.array().cast(SPANS)))
    spans = _listed({k: f"_{k}" for k in KINDS})
    return every.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(_joined(listed), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        "fp",
        spans.alias("all_spans"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; other columns and texts unchanged."""
    found = find_pii(docs).where(F.size("all_spans") > 0).dropDuplicates(["doc_id", "fp"])
    key, fp, spans = (fresh(docs, f"pii_{c}") for c in ("id", "fp", "spans"))
    found = found.select(F.col("doc_id").alias(key), F.col("fp").alias(fp), F.col("all_spans").alias(spans))
    same = docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(fp))
    joined = docs.join(found, same, "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.get(names, x["k"]))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    init = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, init, step)
    masked = F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text)))
    return joined.select(*[F.when(F.col(spans).isNotNull(), masked).otherwise(text).alias("text") if c == "text" else docs[c] for c in docs.columns])
