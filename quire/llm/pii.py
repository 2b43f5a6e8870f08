"""Operator 7, personal data by weak supervision. DataFrame functions only.

Regex rules find the base spans and looser candidates; labelers (regex, gazetteer, context) vote on each span; expectation
maximisation estimates how reliable each labeler is from the histogram of votes; the posteriors then train a naive Bayes classifier
over features of a span, which decides on the candidates. Base spans always stay.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: The base patterns, with possessive repeats and starts only where a match can start: the same matches, in linear time and constant stack.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What else may be personal data: hosts without a dot and written-out signs, IPv6, other separators, numbers without a plus.
LOOSE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++(?:@|\x20?[\[(]at[\])]\x20?){_HOST}++(?:(?:\.|\x20?[\[(]dot[\])]\x20?){_HOST}++)*+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]?[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])[(0-9][\x20().0-9-]{5,24}[0-9](?![0-9A-Za-z])",
}
#: A match of either pattern has this in it; others needn't be searched.
NEEDS = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9]\.[0-9]|:", "card": r"[0-9]", "phone": r"[0-9]"}
#: Words that stand before such data, and words that stand before other numbers.
CONTEXT = {
    "email": r"\b(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\b",
    "ip": r"\b(?:ip|address|host|server|adresse|direcci[oó]n|client)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta|payment)\b",
    "phone": r"\b(?:phone|tel|telephone|call|mobile|fax|cell|telefon|t[eé]l[eé]fono|t[eé]l|appelez)\b",
}
OTHER = r"\b(?:order|invoice|isbn|issn|version|id|no|nr|sku|serial|total|token|hash|page|commit)\b"
#: Fixed values, the gazetteer: endings of hosts, starts of private and documentation networks, issuers' first digits, dialling prefixes.
ENDINGS = "com org net edu gov mil int info biz io dev app ai co me tv xyz online site shop blog cloud de fr es uk eu us ca ch at it nl mx ar be br cl cn cz dk fi gr hu ie il in jp kr lu no nz pl pt ro ru se tr ua za au pe ve uy cat".split()
NETWORKS = "10. 127. 169. 172. 192. 198. 203. fe80 fc fd 200".split()
ISSUERS = "4 51 52 53 54 55 22 23 24 25 26 27 34 37 30 36 38 35 6011 62 64 65".split()
DIALLING = ["+", "00", "("]
_any = lambda words: "|".join(w.translate({ord(c): "\\" + c for c in ".+("}) for w in words)
GAZETTEER = {"email": rf"(?i)(?:\.|dot[\])]\x20?)(?:{_any(ENDINGS)})$", "ip": rf"^(?i:{_any(NETWORKS)})", "card": rf"^(?:{_any(ISSUERS)})", "phone": rf"^(?:{_any(DIALLING)})"}
LABELERS = 5
SPAN = "struct<s:int,k:int,e:int,v:string>"


#: Entries that a fold appends to one by one, and code points of a piece of a text.
RUN, PIECE = 64, 1024
NONE = f"cast(array() as array<{SPAN}>)"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, also where it is used in a function of entries."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """values[0], join(values[0], values[1]), ... of an array of ints, not empty. Folds copy what they append to, so runs of RUN are folded first, then their ends."""
    append = lambda acc, x: F.array_append(acc, join(F.element_at(acc, -1), x))
    fold = lambda xs: F.aggregate(F.slice(xs, 2, F.size(xs)), F.slice(xs, 1, 1), append)
    whole = lambda cut, ends: F.flatten(F.transform(cut, lambda xs, i: F.when(i == 0, xs).otherwise(F.transform(xs, lambda x: join(F.element_at(ends, F.greatest(i, F.lit(1))), x)))))
    cut = lambda vs: F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / RUN).cast("int")), lambda i: _let(F.slice(vs, i * RUN + 1, F.lit(RUN)), fold))
    ends = lambda cut: _let(F.transform(cut, lambda xs: F.element_at(xs, -1)), fold)
    return _let(values, lambda vs: F.when(F.size(vs) <= RUN, fold(vs)).otherwise(_let(cut(vs), lambda c: _let(ends(c), lambda e: whole(c, e)))))


def _places(text: Column, kind: str, pattern: str) -> Column:
    """Start, kind, end (code points) and value of all matches, leftmost and apart: what lies between matches gives their starts."""
    values = F.when(text.rlike(NEEDS[kind]), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    number = F.lit(KINDS.index(kind))
    spans_ = lambda v: F.zip_with(v, _running(F.zip_with(v, F.slice(gaps, 1, F.size(v)), lambda x, g: g + F.length(x)), lambda a, b: a + b), lambda x, e: F.struct((e - F.length(x)).alias("s"), number.alias("k"), e.alias("e"), x.alias("v")))
    return F.when(F.size(values) > 0, _let(values, spans_)).otherwise(F.expr(NONE))


def _apart(candidates: Column, spans_: Column) -> Column:
    """Candidates that overlap none of the spans, by start. Few are compared one by one; many are swept once from either side."""
    few = lambda cs, xs: F.filter(cs, lambda c: ~F.exists(xs, lambda x: (x["s"] < c["e"]) & (c["s"] < x["e"])))

    def sweep(both: Column) -> Column:
        ahead = _running(F.transform(both, lambda x: F.when(x["own"], 0).otherwise(x["x"]["e"])), F.greatest)  # where spans up to here end at the latest
        behind = F.reverse(_running(F.reverse(F.transform(both, lambda x: F.when(x["own"], F.lit(2**31 - 1)).otherwise(x["x"]["s"]))), F.least))  # and from here on start at the earliest
        free = F.zip_with(both, F.arrays_zip(ahead.alias("a"), behind.alias("b")), lambda x, y: F.struct(x["x"].alias("x"), (x["own"] & (y["a"] <= x["x"]["s"]) & (y["b"] >= x["x"]["e"])).alias("free")))
        return F.transform(F.filter(free, lambda y: y["free"]), lambda y: y["x"])

    marked = lambda xs, own: F.transform(xs, lambda x: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), x.alias("x")))
    many = lambda cs, xs: _let(F.array_sort(F.concat(marked(xs, False), marked(cs, True))), sweep)
    return _let(candidates, lambda cs: _let(spans_, lambda xs: F.when(F.size(cs).cast("long") * F.size(xs) <= 4096, few(cs, xs)).otherwise(many(cs, xs))))


def _part(pieces: Column, start: Column, length: Column) -> Column:
    """length code points from start on (from 0) of a text cut into pieces: reads the pieces they lie in, not the text before."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((start + length) / PIECE).cast("int")
    return F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start - first * PIECE + 1, length)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str):
    """The base rule's check of a match."""
    digits = lambda x: _digits(x["v"])
    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["v"].rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"),
        "card": lambda x: F.length(digits(x)).between(12, 19) & F.call_function("luhn_check", digits(x)),
        "phone": lambda x: F.length(digits(x)).between(9, 15),
    }[kind]


def _votes(kind: str, x: Column, base: Column, before: Column, around: Column) -> list[Column]:
    """Each labeler says + (personal), - (not) or 0 (no vote)."""
    digits = _digits(x["v"])
    strict = {"card": F.when(F.call_function("luhn_check", digits), "+").otherwise("-"), "ip": F.lit("+"), "email": F.when(x["v"].rlike(r"\.|[\[(]dot[\])]"), "+").otherwise("-"), "phone": F.when(F.length(digits).between(9, 15), "+").when(F.length(digits) < 8, "-").otherwise("0")}[kind]
    return [
        F.when(base, "+").otherwise("0" if kind == "email" else "-"),
        strict,
        F.when((digits if kind == "card" else x["v"]).rlike(GAZETTEER[kind]), "+").otherwise("-" if kind in ("email", "card") else "0"),
        F.when(before.rlike(CONTEXT[kind]), "+").when(before.rlike(OTHER), "-").otherwise("0"),
        F.when(around.rlike(r"[\p{L}0-9_=]"), "-").otherwise("+"),
    ]


def _features(kind: str, x: Column, base: Column, before: Column, around: Column) -> Column:
    """What the classifier sees of a span: names of a bounded number of features."""
    word = F.pmod(F.xxhash64(F.regexp_extract(before, r"([\p{L}]+)[^\p{L}]*$", 1)), F.lit(256))
    shape = F.regexp_replace(F.regexp_replace(F.substring(_digits(x["v"]), 1, 1), "[0-9]", "9"), "^$", "a")
    named = {
        "base": base.cast("string"),
        "digits": F.least(F.length(_digits(x["v"])), F.lit(24)).cast("string"),
        "length": F.least(F.floor(F.log2(F.length(x["v"]).cast("double"))), F.lit(8)).cast("string"),
        "marks": F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(x["v"], r"[^\x20@.()+:/_-]", ""), ""))), ""),
        "first": shape,
        "before": F.when(before.rlike(CONTEXT[kind]), "yes").when(before.rlike(OTHER), "no").otherwise("-"),
        "word": word.cast("string"),
        "around": around.rlike(r"[\p{L}0-9_=]").cast("string"),
        "listed": x["v"].rlike(GAZETTEER[kind]).cast("string"),
    }
    return F.array(*[F.concat(F.lit(f"{kind}.{name}="), F.coalesce(value, F.lit(""))) for name, value in named.items()])


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (s, k, e, base, votes, features) of docs(doc_id, text): base spans and candidates that overlap none of them."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    t = F.col("t")
    strict = {k: F.filter(_places(t, k, BASE[k]), _valid(k)) for k in KINDS}
    found = text.select("doc_id", "t", F.concat(*strict.values()).alias("b"), *[_places(t, k, LOOSE[k]).alias(k) for k in KINDS])
    rest = {k: _apart(F.col(k), F.col("b")) for k in KINDS}
    found = found.select("doc_id", "t", "b", *[rest[k].alias(k) for k in KINDS])
    found = found.select("doc_id", "t", "b", F.concat("email", "ip", "card", _apart(F.col("phone"), F.concat("email", "ip", "card"))).alias("c"))
    some = F.size("b") + F.size("c") > 0
    found = found.select("doc_id", "b", "c", F.when(some, _pieces(t)).otherwise(F.expr("cast(array() as array<string>)")).alias("pieces"))
    pieces = F.col("pieces")

    def described(x: Column, base: Column) -> Column:
        start = F.greatest(x["s"] - 40, F.lit(0))
        before = F.lower(_part(pieces, start, x["s"] - start))
        around = F.concat(_part(pieces, F.greatest(x["s"] - 1, F.lit(0)), F.when(x["s"] > 0, 1).otherwise(0)), _part(pieces, x["e"], F.lit(1)))
        votes, features = None, None
        for i, kind in reversed([*enumerate(KINDS)]):
            v, f = F.concat(*_votes(kind, x, base, before, around)), _features(kind, x, base, before, around)
            votes = v if votes is None else F.when(x["k"] == i, v).otherwise(votes)
            features = f if features is None else F.when(x["k"] == i, f).otherwise(features)
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), base.alias("base"), votes.alias("votes"), features.alias("features"))

    return found.select("doc_id", F.concat(F.transform("b", lambda x: described(x, F.lit(True))), F.transform("c", lambda x: described(x, F.lit(False)))).alias("spans"))


def reliabilities(histogram: dict[tuple[int, str], int], rounds: int = 50) -> dict[tuple[int, str], float]:
    """Posteriors of vote patterns, by expectation maximisation over (kind, votes) counts.

    A span is personal or not; given that, each labeler votes by itself with rates to be estimated. It starts from the majority.
    The input has at most len(KINDS) * 3 ** LABELERS entries, however many spans there are.
    """
    out = {}
    for kind in {k for k, _ in histogram}:
        rows = {v: n for (k, v), n in histogram.items() if k == kind}
        post = {v: (v.count("+") + 0.5) / (v.count("+") + v.count("-") + 1) for v in rows}
        for _ in range(rounds):
            total = {1: 2.0, 0: 2.0}
            rate: dict = defaultdict(lambda: 0.5)
            for v, n in rows.items():
                for y, p in ((1, post[v]), (0, 1 - post[v])):
                    total[y] += n * p
                    for i, c in enumerate(v):
                        rate[y, i, c] += n * p
            for v in rows:
                score = {y: math.log(total[y]) + sum(math.log(rate[y, i, c] / (total[y] - 0.5)) for i, c in enumerate(v)) for y in (0, 1)}
                post[v] = 1 / (1 + math.exp(max(-700.0, min(700.0, score[0] - score[1]))))
        out |= {(kind, v): p for v, p in post.items()}
    return out


def trained(found: DataFrame) -> dict[str, float]:
    """Log odds of the classifier's features, and "<kind>" for a kind's prior, from spans() by posteriors as soft labels."""
    spark = found.sparkSession
    each = found.select(F.explode("spans").alias("x")).select("x.k", "x.votes", "x.features")
    counts = {(r.k, r.votes): r.n for r in each.groupBy("k", "votes").agg(F.count("*").alias("n")).collect()}  # 3 ** LABELERS for each kind at most
    post = reliabilities(counts)
    if not post:
        return {}
    table = spark.createDataFrame([(k, v, float(p)) for (k, v), p in post.items()], "k int, votes string, p double")
    sums = each.join(F.broadcast(table), ["k", "votes"]).select(F.explode("features").alias("f"), "p").groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # bounded by the names that _features can make
    weights, total = {}, {}
    for i, kind in enumerate(KINDS):
        yes = sum(n * post[k, v] for (k, v), n in counts.items() if k == i)
        no = sum(n for (k, _), n in counts.items() if k == i) - yes
        total[kind] = (yes, no)
        weights[kind] = math.log((yes + 1) / (no + 1))
    for r in sums:
        yes, no = total[r.f.split(".")[0]]
        weights[r.f] = math.log((r.yes + 0.5) / (yes + 2)) - math.log((r.no + 0.5) / (no + 2))
    return weights


def private(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id and spans (s, k, e, base, p) of personal data in docs(doc_id, text): all base spans, and candidates of p >= threshold.

    Texts are read once; what follows reads the spans found. Nothing is grouped by document, so long texts and repeated rows need no
    shuffle; a text with m spans costs about m ** 1.5 at worst. A null text is empty and has no spans; an empty table gives no rows; other columns are not read.
    """
    found = common.save(spans(docs), "pii")
    weights = trained(found)
    known = F.create_map(*[F.lit(x) for item in sorted(weights.items()) for x in item]) if weights else F.expr("cast(map() as map<string,double>)")

    def chance(x: Column) -> Column:
        sums = F.aggregate(F.transform(x["features"], lambda f: F.coalesce(known[f], F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
        prior = F.coalesce(F.element_at(F.array(*[F.lit(float(weights.get(k, 0.0))) for k in KINDS]), x["k"] + 1), F.lit(0.0))
        return 1 / (1 + F.exp(-(sums + prior)))

    rated = F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["base"].alias("base"), F.when(x["base"], 1.0).otherwise(chance(x)).alias("p")))
    return found.select("doc_id", F.array_sort(F.filter(rated, lambda x: x["base"] | (x["p"] >= threshold))).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the base spans of each text replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; those that overlap become one, named by the first."""
    t = F.coalesce("text", F.lit(""))
    strict = F.array_sort(F.concat(*[F.filter(_places(t, k, BASE[k]), _valid(k)) for k in KINDS]))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def done(row: Column) -> Column:
        spans_, pieces, n = row["spans"], row["pieces"], row["n"]
        return _let(F.concat(F.array(F.lit(0)), _running(F.transform(spans_, lambda x: x["e"]), F.greatest)), lambda ends: regions(spans_, pieces, n, ends))

    def regions(spans_: Column, pieces: Column, n: Column, ends: Column) -> Column:  # ends: where the spans before end at the latest
        first = F.filter(F.zip_with(spans_, F.slice(ends, 1, F.size(spans_)), lambda x, e: F.struct(x.alias("x"), e.alias("e"))), lambda y: y["x"]["s"] >= y["e"])

        def filled(first: Column) -> Column:
            froms = F.concat(F.transform(first, lambda y: y["e"]), F.slice(ends, -1, 1))
            parts = F.transform(froms, lambda a, i: F.concat(_part(pieces, a, F.coalesce(F.get(first, i)["x"]["s"], n) - a), F.when(F.get(first, i).isNull(), "").otherwise(F.element_at(names, F.coalesce(F.get(first, i)["x"]["k"], F.lit(0)) + 1))))
            return F.array_join(parts, "")

        return _let(first, filled)

    row = F.struct(strict.alias("spans"), _pieces(t).alias("pieces"), F.length(t).alias("n"))
    clean = F.element_at(F.transform(F.array(row), lambda r: F.when(F.size(r["spans"]) > 0, done(r)).otherwise(t)), 1)
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), clean)).select(docs.columns)


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private(common.documents(spark, sf_dir))
    names = F.array(*map(F.lit, KINDS))
    base = F.filter("spans", lambda x: x["base"])
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")
    of = lambda i: lambda x: x["k"] == i
    counts = [F.size(F.filter(base, of(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
