"""Secret scans: patterns, and a battery of randomness tests (operator 6).

Only DataFrame functions: every text stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import beside

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # as the whole run AKIA[A-Z0-9]+, kept from 20 characters on
HEX = r"[0-9a-f]{24,}"  # as the whole run [0-9a-f]+, kept from 24 characters on
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]

#: Encodings a token may be in, narrowest first, with their alphabets in order.
DIGITS, LOW, UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("hex", DIGITS + "abcdef"),
    ("hex_upper", DIGITS + "ABCDEF"),
    ("base32", UP + "234567"),
    ("base36", DIGITS + LOW),
    ("base36_upper", DIGITS + UP),
    ("base62", DIGITS + UP + LOW),
    ("base64", UP + LOW + DIGITS + "+/"),
    ("base64_url", UP + LOW + DIGITS + "-_"),
]
BINS = 200
BLOCK = 128

#: What a stratum is taken to hold before its tokens are seen: PRIOR random tokens, their p
#: spread evenly, and as many others, with p just below a level that falls with length.
PRIOR = 30
LEVELS = {20: 0.25, 24: 0.1, 32: 0.05, 48: 0.02, 96: 0.01}

_span = "array<struct<start:int,end:int,kind:string,text:string>>"


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def in_blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK items; none of an empty one."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(items) > 0, blocks).otherwise(F.filter(F.array(items), lambda x: F.size(x) > 0))


def _found(text: Column, pattern: str, kind: str, possible: Column) -> Column:
    """Spans of all matches, leftmost and not overlapping, in code points. The pieces
    between the matches give the places: first within blocks of matches, then the blocks'
    own, since arrays are copied as they grow. Texts where no match is ``possible`` are
    passed over."""
    empty = F.array().cast(_span)
    span = lambda start, end, match: F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), match.alias("text"))

    def add(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span(start, end, pair["match"]))).alias("spans"))

    def placed(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        pairs = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
        start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
        blocks = let(pairs, lambda own: F.transform(in_blocks(own), lambda block: F.aggregate(block, start, add)))

        def moved(done: Column) -> Column:
            starts = F.aggregate(done, F.array(F.lit(0)), lambda a, d: F.concat(a, F.array(F.element_at(a, -1) + d["at"])))
            return let(starts, lambda at: F.flatten(F.transform(done, lambda d, i: F.transform(d["spans"], lambda s: span(s["start"] + F.get(at, i), s["end"] + F.get(at, i), s["text"])))))

        return F.when(F.size(matches) > 0, let(blocks, moved)).otherwise(empty)

    return F.when(possible, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(empty)


def _apart(tokens: Column, spans: Column) -> Column:
    """The tokens that meet no span, block by block: only spans within a block's reach are
    held against its tokens."""

    def of_block(block: Column) -> Column:
        first, last = F.element_at(block, 1)["start"], F.element_at(block, -1)["end"]
        near = let(F.struct(first.alias("a"), last.alias("b")), lambda r: F.filter(spans, lambda s: (s["start"] < r["b"]) & (r["a"] < s["end"])))
        return let(near, lambda n: F.filter(block, lambda t: ~F.exists(n, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))))

    return let(tokens, lambda own: F.flatten(F.transform(in_blocks(own), of_block)))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the three patterns. What cannot match is passed over by plain searches,
    which find every text that a pattern could match."""
    low = F.lower(text)
    named = F.contains(low, F.lit(WORDS[0]))
    for w in WORDS[1:]:
        named = named | F.contains(low, F.lit(w))
    return {
        "assign": F.filter(_found(text, ASSIGN, "assign", named), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 6),
        "access": _found(text, ACCESS, "access", F.contains(text, F.lit("AKIA"))),
        "hex": _found(text, HEX, "hex", text.rlike(HEX)),
    }


def _normal_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z, by a logistic fit."""
    return let(z, lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.greatest(v * (F.lit(1.5976) + F.lit(0.070565) * v * v), F.lit(-700.0)), F.lit(700.0)))))


def battery(token: Column) -> Column:
    """(encoding, length, p) of a token: p is the combined level (Fisher) at which
    chi-squared uniformity over the alphabet, runs above and below the middle of the
    alphabet, and serial correlation at lag one reject a uniform random string."""

    def inferred(body: Column) -> Column:
        which = F.lit(len(ENCODINGS))
        for i, (_, letters) in reversed(list(enumerate(ENCODINGS))):
            which = F.when(F.translate(body, letters, "") == "", F.lit(i)).otherwise(which)
        return F.struct(body.alias("body"), (which + 1).alias("which"))

    def ranked(x: Column) -> Column:
        alphabet = F.element_at(F.array(*[F.lit(a) for _, a in ENCODINGS], F.lit(UP + LOW + DIGITS + "+/-_=")), x["which"])
        chars = F.split(x["body"], "")
        size = F.element_at(F.array(*[F.lit(float(len(a))) for _, a in ENCODINGS], F.lit(67.0)), x["which"])
        ranks = let(alphabet, lambda a: F.transform(chars, lambda c: F.instr(a, c).cast("double")))
        name = F.element_at(F.array(*[F.lit(n) for n, _ in ENCODINGS], F.lit("mixed")), x["which"])
        return F.struct(name.alias("encoding"), size.alias("size"), F.length(x["body"]).cast("double").alias("n"), ranks.alias("ranks"))

    def sums(x: Column) -> Column:
        n, ranks = x["n"], x["ranks"]
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        squares = total(F.transform(F.array_distinct(ranks), lambda c: let(F.size(F.filter(ranks, lambda d: d == c)).cast("double"), lambda k: k * k)))
        first, second = F.slice(ranks, F.lit(1), F.size(ranks) - 1), F.slice(ranks, F.lit(2), F.size(ranks) - 1)
        half = (x["size"] + 1.0) / 2.0
        changes = total(F.zip_with(first, second, lambda a, b: F.when((a > half) != (b > half), 1.0).otherwise(0.0)))
        up = F.size(F.filter(ranks, lambda r: r > half)).cast("double")
        middle = total(ranks) / n
        moments = let(middle, lambda m: F.struct(total(F.transform(ranks, lambda r: (r - m) * (r - m))).alias("whole"), total(F.zip_with(first, second, lambda a, b: (a - m) * (b - m))).alias("lagged")))
        free = x["size"] - 1.0
        return F.struct(x["encoding"].alias("encoding"), n.alias("n"), free.alias("free"), (squares * x["size"] / n - n).alias("chi"), (changes + 1.0).alias("runs"), (up * (n - up) * 2.0 / n + 1.0).alias("mean"), moments.alias("m"))

    def levels(x: Column) -> Column:
        n, spread = x["n"], F.lit(2.0) / (x["free"] * 9.0)
        p_chi = _normal_tail((F.pow(F.greatest(x["chi"] / x["free"], F.lit(0.0)), F.lit(1.0 / 3)) - (F.lit(1.0) - spread)) / F.sqrt(spread))
        var = (x["mean"] - 1.0) * (x["mean"] - 2.0) / (n - 1.0)
        p_runs = let(var, lambda v: F.when(v > 0, _normal_tail(F.abs(x["runs"] - x["mean"]) / F.sqrt(v)) * 2.0).otherwise(F.lit(1e-6)))
        p_serial = F.when(x["m"]["whole"] > 0, _normal_tail(F.abs(x["m"]["lagged"] / x["m"]["whole"] + F.lit(1.0) / n) * F.sqrt(n)) * 2.0).otherwise(F.lit(1e-6))
        logs = [F.log(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0))) for p in (p_chi, p_runs, p_serial)]
        p = let(-(logs[0] + logs[1] + logs[2]), lambda half: F.exp(-half) * (F.lit(1.0) + half + half * half / 2.0))
        return F.struct(x["encoding"].alias("encoding"), n.cast("int").alias("length"), p.alias("p"))

    nothing = F.struct(F.lit("mixed").alias("encoding"), F.lit(0).alias("length"), F.lit(0.0).alias("p"))
    whole = lambda body: F.when(F.length(body) > 1, let(let(let(inferred(body), ranked), sums), levels)).otherwise(nothing)
    return let(F.regexp_replace(token, "=+$", ""), whole)


def stratum(encoding: Column, length: Column) -> Column:
    """Encoding and length class: tests of short tokens say less, so error rates are
    held within classes of length."""
    classes = sorted(LEVELS)
    size = F.lit(str(classes[-1]))
    for own, above in reversed(list(zip(classes, classes[1:], strict=False))):
        size = F.when(length < above, str(own)).otherwise(size)
    return F.concat_ws(":", encoding, size)


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def candidates(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with _scan: base (the base spans) and tested (start, end, text, stratum
    and p of long tokens that meet no base span)."""
    text = _text(column)
    base = F.concat(*base_spans(text).values())

    def tested(b: Column) -> Column:
        long = _found(text, TOKEN, "random", text.rlike(TOKEN))
        judged = F.transform(_apart(long, b), lambda t: F.struct(t.alias("t"), battery(t["text"]).alias("b")))
        out = F.transform(judged, lambda x: F.struct(x["t"]["start"].alias("start"), x["t"]["end"].alias("end"), x["t"]["text"].alias("text"), stratum(x["b"]["encoding"], x["b"]["length"]).alias("stratum"), x["b"]["p"].alias("p")))
        return F.struct(b.alias("base"), out.alias("tested"))

    return docs.withColumn("_scan", let(base, tested))


def thresholds(tested: DataFrame, rate: float = 0.1) -> dict[str, float]:
    """For each stratum, the least p from which tokens count as random, such that at
    most ``rate`` of those are expected not to be. Random tokens have p spread evenly, so
    those above one half, doubled, estimate their number. Tokens of one text are one test,
    however often it occurs. Each stratum starts with the tokens of PRIOR, so one of few
    tokens has about its length's level, and one of many its own. The histogram has BINS
    rows a stratum, over all documents, and so may be gathered."""
    low = F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).cast("int")
    once = tested.select(F.explode("_scan.tested").alias("t")).select(F.col("t.stratum").alias("stratum"), low.alias("bin"), F.xxhash64("t.text").alias("text")).distinct()
    bins: dict[str, list[float]] = {}
    for r in once.groupBy("stratum", "bin").count().collect():
        bins.setdefault(r.stratum, [PRIOR / BINS] * BINS)[r.bin] += r["count"]
    out = {}
    for name, c in bins.items():
        c[round(LEVELS[int(name.split(":")[1])] * BINS) - 1] += PRIOR
        random = 2.0 * sum(c[BINS // 2 :])
        flagged = [sum(c[i:]) for i in range(BINS)]
        out[name] = next((i / BINS for i in range(BINS) if 1 - random * (1 - i / BINS) / flagged[i] <= rate), 1.0)
    return out


def scan(docs: DataFrame, column: str = "text", rate: float = 0.1) -> DataFrame:
    """``docs`` with spans: array of (start, end, kind, text) by start, then kind.

    The base patterns give assign, access and hex; other tokens of 20 characters or more
    are tested for randomness in the narrowest encoding that has all their characters, and
    those that pass at their stratum's threshold are of kind random. Two narrow passes
    and one small aggregate of distinct tokens' hashes; no text is shuffled.

    A null text is an empty one and has no spans; tokens of one character repeated
    fail every test; repeated rows give a row each; an empty table gives none. A
    column named spans is replaced."""
    tested = candidates(docs.drop("spans"), column)
    least = thresholds(tested, rate)
    table = F.create_map(*[F.lit(x) for name, p in sorted(least.items()) for x in (name, p)]) if least else F.lit(None).cast("map<string,double>")
    random = F.filter("_scan.tested", lambda t: F.coalesce(t["p"] >= F.element_at(table, t["stratum"]), F.lit(False)))
    random = F.transform(random, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("random").alias("kind"), t["text"].alias("text")))
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(F.concat("_scan.base", random), lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text")))
    spans = F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text")))
    return tested.withColumn("spans", spans).drop("_scan")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of scan()."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return scanned.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` (text), with each span of scan() replaced by ``mark``; spans that meet are
    replaced as one. Texts without spans and all other columns are unchanged."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(done: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"])
        fresh = F.concat(done["out"], gap, F.lit(mark))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(s["start"] < done["at"], done["out"]).otherwise(fresh).alias("out"))

    text = F.aggregate("spans", start, add, lambda d: F.concat(d["out"], F.substring(F.col("text"), d["at"] + 1, F.length("text"))))
    return beside(docs, ["spans", "_scan"], lambda d: scan(d).withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text"))))
