"""Operator 10 [native]: personal data by patterns, and by bootstrapped contexts.

Four base patterns find e-mail and IP addresses, cards (Luhn) and phone numbers: the seeds. A lexical
pattern is the pair of words before the word that an entity begins in, wherever they stand and however long
they are. Instances are the seeds and every other token that looks like an identifier; patterns and instances
form a graph that Spark scores in ROUNDS rounds: a pattern's confidence is the summed score of the instances it
precedes over all its occurrences in the corpus, whatever follows there; an instance's score is 1 for a seed,
else the noisy-or of its patterns' confidences. Unseen tokens after a pattern of confidence LEAST_CONFIDENCE
become spans of kind ``context``. Every pattern of MIN_VALUES different instances or more is scored.

Words come from one pass over a text that carries the last two words along, so that a word that is itself a
match counts as a word like any other.

Defined results: a null or empty text has no spans; a very long text takes time in proportion to its words, and
to its tokens times its base matches; of repeated rows each is reported; an empty table gives no row; extra
columns are carried whatever their names, and those named like a result replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm import spans
from gridweave.llm.shared import WORD_SPACE, back, checkpointed, hot_slots, in_slots, renamed, seen_slots, spread_join, text_or_empty

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "context")

#: A token that may be an identifier: between white space, with a digit or an at sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
EDGES = r"^[^A-Za-z0-9]+"
TOKEN_DIGITS, TOKEN_CHARS = 4, 6

ROUNDS = 3
MIN_VALUES = 3
LEAST_CONFIDENCE = 0.6
RESULTS = ("base_spans", "spans")
#: A token with the word (from, to) that it stands in and the pair of words before that.
TOKENS = "array<struct<kind:string,start:int,end:int,value:string,from:int,to:int,context:string>>"


def digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def base_spans(text: Column) -> Column:
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.substring(F.ltrim(p, F.lit("0")), 1, 4)).cast("int") <= 255)
    ip = F.filter(spans.matches(text, IP, "ip"), lambda s: F.forall(F.split(s["value"], "[.]"), small))
    card = F.filter(spans.matches(text, CARD, "card"), lambda s: F.call_function("luhn_check", F.regexp_replace(s["value"], "[ -]", "")))
    phone = F.filter(spans.matches(text, PHONE, "phone"), lambda s: digits(s["value"]).between(10, 15))
    email = F.when(F.contains(text, F.lit("@")), spans.matches(text, EMAIL, "email")).otherwise(spans.none())
    return F.concat(email, ip, card, phone)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), rf"[{WORD_SPACE}]+"), lambda w: w != "")


def token_words(text: Column) -> Column:
    """The words that hold a digit or an at sign, each with the pair of words before it (null where there are fewer)."""
    parts = F.transform(spans.between(text, TOKEN), lambda x: F.struct(x["b"].alias("b"), x["m"].alias("m"), F.slice(F.concat(F.array(F.lit(""), F.lit("")), words(x["b"])), F.lit(-2), F.lit(2)).alias("last")))

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        begin = acc["at"] + F.length(x["b"])
        end = begin + F.length(x["m"])
        one, two = F.get(x["last"], 1), F.get(x["last"], 0)  # the last word since the previous match, and the one before
        back = F.when(one != "", one).otherwise(acc["one"])
        far = F.when(two != "", two).when(one != "", acc["one"]).otherwise(acc["two"])
        span = F.struct(
            F.lit("context").alias("kind"), begin.alias("start"), end.alias("end"), x["m"].alias("value"), begin.alias("from"), end.alias("to"),
            F.when((back != "") & (far != ""), F.concat_ws(" ", far, back)).alias("context"),
        )
        return {"at": end, "one": F.lower(x["m"]), "two": back}, span

    found = spans.gathered(parts, {"at": F.lit(0), "one": F.lit(""), "two": F.lit("")}, TOKENS, step)
    return F.when(text.rlike(TOKEN), found).otherwise(spans.none(TOKENS))


def token_spans(found: Column) -> Column:
    """Those of ``token_words`` that look like identifiers, without marks around them."""

    def trimmed(s: Column) -> Column:
        inner = F.regexp_replace(s["value"], EDGES, "")
        start = s["start"] + F.length(s["value"]) - F.length(inner)
        core = F.regexp_replace(inner, r"[^A-Za-z0-9]++$", "")
        return F.struct(s["kind"].alias("kind"), start.alias("start"), (start + F.length(core)).alias("end"), core.alias("value"), s["context"].alias("context"))

    return F.filter(F.transform(found, trimmed), lambda s: (F.length(s["value"]) >= TOKEN_CHARS) & ((digits(s["value"]) >= TOKEN_DIGITS) | F.contains(s["value"], F.lit("@"))))


def seeds(base: Column, found: Column) -> Column:
    """(value, context) of base spans: a base span begins in a word with a digit or an at sign."""
    of = lambda s: F.get(F.filter(found, lambda w: (w["from"] <= s["start"]) & (s["start"] < w["to"])), 0)["context"]
    return F.transform(base, lambda s: F.struct(s["value"].alias("value"), of(s).alias("context")))


def occurrences(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """context, occ: how often each pair of words of ``contexts`` stands in the corpus.

    Pairs are tested against a bitmap first, then counted where they stand, and only the counts are
    shuffled and joined."""
    each_text = docs.select(F.explode(F.array(words(text_or_empty()))).alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    each = each_text.select(F.explode(pairs).alias("p")).where("p.b is not null").select(F.concat_ws(" ", "p.a", "p.b").alias("context"))
    counts = each.where(in_slots(seen_slots(contexts, "context"), "context")).groupBy("context").agg(F.count("*").alias("occ"))
    return counts.join(contexts, "context", "left_semi")


def confident(docs: DataFrame, instances: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """context, confidence of the patterns; ``instances``: context, value, seed."""
    edges = checkpointed(instances.where("context is not null").groupBy("context", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    support = edges.groupBy("context").agg(F.count("*").alias("values")).where(F.col("values") >= MIN_VALUES)
    patterns = checkpointed(support.select("context"))
    occ = checkpointed(occurrences(docs, patterns))
    hot = {c: hot_slots(edges.groupBy(c).agg(F.count("*").alias("n")), c) for c in ("context", "value")}
    edges = checkpointed(spread_join(edges, occ, ["context"], hot["context"]))
    scores = edges.groupBy("value").agg(F.max("seed").cast("double").alias("score"))
    for _ in range(rounds):
        gain = spread_join(edges, scores, ["value"], hot["value"]).groupBy("context", "occ").agg(F.sum(F.col("n") * F.col("score")).alias("gain"))
        # several entities of one word share its context, hence the bound
        conf = checkpointed(gain.select("context", F.least(F.lit(1.0), F.col("gain") / F.col("occ")).alias("confidence")))
        doubt = F.sum(F.col("n") * F.log(F.lit(1.0) - F.least(F.col("confidence"), F.lit(0.999))))
        scores = spread_join(edges, conf, ["context"], hot["context"]).groupBy("value").agg(F.when(F.max("seed"), 1.0).otherwise(F.lit(1.0) - F.exp(doubt)).alias("score"))
    return conf


def found_spans(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with base_spans and spans: arrays of (kind, start, end, value), in order."""
    docs = docs.drop(*RESULTS)
    d, own = renamed(docs)
    text = text_or_empty(own.pop("text"))
    rest = [*own.values()]
    seen = d.select(*rest, F.explode(F.array(F.struct(base_spans(text).alias("base"), token_words(text).alias("words")))).alias("_s"))
    seen = seen.select(*rest, F.col("_s.base").alias("_base"), seeds(F.col("_s.base"), F.col("_s.words")).alias("_seeds"), F.explode(F.array(token_spans(F.col("_s.words")))).alias("_tokens"))
    rows = seen.select(*rest, "_base", "_seeds", spans.outside(F.col("_tokens"), F.col("_base")).alias("_tokens"))
    rows = checkpointed(rows.withColumn("_row", F.monotonically_increasing_id()))

    tokens = rows.select("_row", F.explode("_tokens").alias("s")).where("s.context is not null")
    instances = [d.select("s.context", F.lower("s.value").alias("value"), F.lit(seed).alias("seed")) for d, seed in ((rows.select(F.explode("_seeds").alias("s")), True), (tokens, False))]
    good = confident(docs, instances[0].unionByName(instances[1])).where(F.col("confidence") >= LEAST_CONFIDENCE).select("context")
    plain = F.struct("s.kind", "s.start", "s.end", "s.value")
    named = tokens.withColumn("context", F.col("s.context"))
    new = spread_join(named, good, ["context"], hot_slots(named.groupBy("context").agg(F.count("*").alias("n")), "context")).groupBy("_row").agg(F.collect_list(plain).alias("_new"))
    out = rows.join(new, "_row", "left")
    both = out.select(*rest, spans.ordered(F.col("_base"), KINDS).alias("_old"), spans.ordered(F.concat("_base", F.coalesce("_new", spans.none())), KINDS).alias("_all"))
    return both.select(*back(own), F.col("_old").alias("base_spans"), F.col("_all").alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    base = F.col("base_spans")
    return found.select("doc_id", *(spans.count(base, k).alias(f"n_{k}") for k in KINDS[:4]), F.sha2(spans.joined(base), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in capitals and angle brackets, as in <EMAIL>."""
    found = found_spans(docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("own"), "text")).where(F.size("spans") > 0)
    found = found.groupBy("doc", "own").agg(F.first("spans").alias("spans"))  # equal for equal texts
    d, own = renamed(docs)
    d = d.withColumn("this", F.xxhash64(own["text"]))
    joined = d.join(found, d[own["doc_id"]].eqNullSafe(found["doc"]) & (d["this"] == found["own"]), "left").select(*own.values(), "spans")
    whole = F.col(own["text"])

    def step(acc: Column, s: Column) -> tuple[dict[str, Column], Column]:
        before = F.concat(F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return {"at": F.greatest(acc["at"], s["end"])}, F.when(s["start"] >= acc["at"], before).otherwise("")

    parts = spans.gathered(F.col("spans"), {"at": F.lit(0)}, "array<string>", step)
    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    text = F.when(F.col("spans").isNull(), whole).otherwise(F.concat(F.array_join(parts, ""), F.substring(whole, last + 1, F.length(whole))))
    return joined.select(*back(own, text=text))
