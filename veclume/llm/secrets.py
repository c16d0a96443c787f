"""Secret scans with character Markov models, by DataFrame functions only.

Base kinds are three patterns: assignments, access keys and runs of hex digits.
The method adds spans of kind `markov`: tokens of 8 or more characters whose
log-likelihood under a first-order character model of random strings exceeds
that under one of ordinary identifiers by ``least_ratio`` nats of their length
or more, and which no base span holds. Shorter tokens are not judged: the models
learn from 8 characters on, and a few pairs don't tell.

Both models are trained from labelled samples: tokens of the corpus that the
base patterns single out are random strings, other tokens are identifiers.
About ``SAMPLE`` documents, chosen by a hash of the id, give the counts (a bound
on what is fitted); counts are of pairs of characters of a fixed alphabet, so
the driver gets at most 2 x 66 x 66 rows. Half of the random model is uniform,
since samples of secrets are few and of few kinds.

Positions: a match is put between two marks by ``regexp_replace`` and the text
is split at the marks; lengths of the pieces, added up, give code points. Marks
that a text holds itself are replaced first by a character that no pattern
takes, one for one. Null text is empty text. Rows keep their multiplicity;
other columns are kept by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 20_000
#: Least ratio of tokens of ``SHORTEST`` characters, its growth by character, and its greatest value. Ordinary tokens
#: of the middle table reach 2.0 at 8 and 9 characters, 4.9 at 10 and 11, and are negative beyond.
SHORTEST, FIRST_RATIO, RATIO_STEP, LEAST_RATIO = 8, 7.0, 1.25, 12.0
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
UNIFORM = 0.5
#: Pieces of a text that are added up together; even, as every other piece is a match.
GROUP = 128
MARK, INNER, PLAIN = "", "", "\u0001"
#: Patterns of the base kinds, in the order of ties.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
WORDS = f"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
KINDS = ("assign", "access", "hex", "markov")
SPAN = "struct<start:int,kind:int,end:int>"
REPLACEMENT = "[secret]"


def _clean(text_col: str) -> Column:
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK + INNER, PLAIN * 2)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value made once: the one element of an array is bound to a name."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _spans(text: Column, pattern: str, replacement: str, kind: int, inner: bool = False, accept: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the matches of a pattern that accept takes; an assignment counts if what follows the inner mark has 6 characters or more.

    Pieces are added up in groups of GROUP, then the groups, so that no array
    grows piece by piece over a whole text: the work follows the text's length.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, piece: Column) -> Column:
        marked = acc["i"] % 2 == 1
        size = F.length(piece) - F.when(marked, F.lit(1 if inner else 0)).otherwise(F.lit(0))
        good = marked & (F.length(F.substring_index(piece, INNER, -1)) >= 6) if inner else marked & accept(piece) if accept else marked
        span = F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), (acc["at"] + size).alias("end"))
        return F.struct((acc["at"] + size).alias("at"), (acc["i"] + 1).alias("i"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def found(pieces: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), none.alias("spans"))
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / GROUP).cast("int")), lambda g: F.aggregate(F.slice(pieces, g * GROUP + 1, GROUP), zero, step))
        return _bound(groups, moved)

    def moved(groups: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        begins = F.aggregate(groups, start, lambda acc, g: F.struct((acc["at"] + g["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])
        return F.flatten(F.zip_with(groups, begins, lambda g, at: F.transform(g["spans"], lambda x: F.struct((x["start"] + at).alias("start"), x["kind"].alias("kind"), (x["end"] + at).alias("end")))))

    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(replacement)), MARK, -1)
    return F.when(text.rlike(pattern), _bound(pieces, found)).otherwise(none)


def _pairs(token: Column) -> Column:
    """Indexes of the pairs of characters of a token in the table of the model."""
    n = len(ALPHABET)
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return _bound(places, lambda at: F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at)), lambda a, b: a * n + b - n))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios by pair of characters, random strings against identifiers."""
    total = docs.select(F.count("*")).first()[0]
    whole = 1 << 40
    picked = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(9)), F.lit(whole)) < int(whole * min(1.0, sample / max(total, 1))))
    text = _clean(text_col)
    words = F.explode(F.regexp_extract_all(text, F.lit(f"({WORDS})"), F.lit(1)))
    plain = picked.select(words.alias("token"), F.lit(0).alias("label"))
    random = F.col("token").rlike(f"^({HEX}|{ACCESS})$")
    plain = plain.select("token", F.when(random, 1).otherwise(0).alias("label"))
    values = picked.where(text.rlike(ASSIGN)).select(F.explode(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).alias("token"), F.lit(1).alias("label"))
    values = values.where((F.length("token") >= 16) & F.col("token").rlike("[0-9]") & F.col("token").rlike("^[A-Za-z0-9+/_=-]+$"))
    rows = plain.unionByName(values)
    counts = rows.select("label", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n")).collect()
    n = len(ALPHABET)
    seen = [[0.0] * (n * n + 1) for _ in range(2)]
    for r in counts:
        seen[r.label][r.pair] += r.n
    table = []
    for a in range(n):
        row = [s[a * n + 1 : a * n + n + 1] for s in seen]
        of = [sum(x) for x in row]
        for b in range(n):
            ident = (row[0][b] + 0.5) / (of[0] + 0.5 * n)
            rand = (row[1][b] + 0.5) / (of[1] + 0.5 * n)
            table.append(round(math.log(UNIFORM / n + (1 - UNIFORM) * rand) - math.log(ident), 3))
    return table


def least_ratio(size: Column) -> Column:
    return F.least(F.lit(LEAST_RATIO), FIRST_RATIO + RATIO_STEP * (size - SHORTEST))


def _with_spans(docs: DataFrame, table: list[float], text_col: str) -> DataFrame:
    """(row, text, assign, access, hex, base, markov, spans) of each row of docs, held as a struct: no name can clash."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _clean(text_col).alias("text"))
    df = df.withColumn("assign", _spans(F.col("text"), ASSIGN, f"{MARK}$1{INNER}$2{MARK}", 0, True))
    df = df.withColumn("access", _spans(F.col("text"), ACCESS, f"{MARK}$0{MARK}", 1))
    df = df.withColumn("hex", _spans(F.col("text"), HEX, f"{MARK}$0{MARK}", 2))
    df = df.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    ratios = F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<double>")
    score = lambda token: F.aggregate(_pairs(token), F.lit(0.0), lambda acc, k: acc + F.element_at(ratios, k))
    df = df.withColumn("random", _spans(F.col("text"), WORDS, f"{MARK}$0{MARK}", 3, accept=lambda token: score(token) >= least_ratio(F.length(token))))
    held = lambda span: F.exists(F.col("base"), lambda b: (b["start"] <= span["start"]) & (b["end"] >= span["end"]))
    df = df.withColumn("markov", F.filter("random", lambda span: ~held(span)))
    return df.withColumn("spans", F.array_sort(F.concat("base", "markov")))


def _joined(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_markov, base, spans): spans as kind:start:end, comma-joined."""
    df = _with_spans(docs.select(id_col, text_col), table, text_col)
    count = lambda c: F.size(c).cast("long")
    return df.select(F.col("row")[id_col].alias(id_col), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), count("markov").alias("n_markov"), _joined("base").alias("base"), _joined("spans").alias("spans"))


def redact(docs: DataFrame, table: list[float], text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, every span replaced by ``[secret]`` (overlapping ones once); texts without a span stay as they are."""
    df = _with_spans(docs, table, text_col)
    text = F.col("row")[text_col]
    far = F.lit(2**31 - 1)

    def put(spans: Column) -> Column:
        """The text between spans, in groups of GROUP spans, each cut from the part of the text that it covers."""
        groups = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / GROUP).cast("int"))
        of = lambda g: F.slice(spans, g * GROUP + 1, GROUP)
        most = F.transform(groups, lambda g: F.array_max(F.transform(of(g), lambda s: s["end"])))
        ends = F.aggregate(most, F.array(F.lit(0)), lambda acc, m: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), m))))

        def kept(g: Column, ends: Column) -> Column:
            begin = F.element_at(ends, g + 1)
            zero = F.struct(begin.alias("end"), F.array().cast("array<struct<a:int,b:int>>").alias("gaps"))
            gaps = F.aggregate(of(g), zero, step, lambda acc: acc["gaps"])
            part = F.substr(text, begin + 1, F.element_at(ends, g + 2) - begin)
            return _bound(part, lambda own: F.transform(gaps, lambda x: F.substr(own, x["a"] - begin + 1, x["b"] - x["a"])))

        def step(acc: Column, s: Column) -> Column:
            apart = F.array(F.struct(acc["end"].alias("a"), s["start"].alias("b")))
            return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), F.when(s["start"] >= acc["end"], F.concat(acc["gaps"], apart)).otherwise(acc["gaps"]).alias("gaps"))

        last = lambda ends: F.array(F.substr(text, F.element_at(ends, -1) + 1, far))
        return _bound(ends, lambda ends: F.array_join(F.concat(F.flatten(F.transform(groups, lambda g: kept(g, ends))), last(ends)), REPLACEMENT))

    new = F.when(F.size("spans") > 0, put(F.col("spans"))).otherwise(text)
    return df.select(*[(new if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def secret_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_markov")
