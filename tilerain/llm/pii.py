"""Personal data by patterns of its own, and identifiers that bootstrapped contexts give away.

Only DataFrame operations: positions come from the pieces between matches, Luhn sums from array functions, and the
scores of contexts and identifiers from joins and aggregations over their graph.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilerain.llm.common import stored, text_of

#: The kinds in the order in which spans are listed; the last is what contexts find.
KINDS = ("email", "ip", "card", "phone", "id")
#: Rounds of scoring; support and confidence from which a context counts; score from which an identifier is taken.
ROUNDS, SUPPORT, CONFIDENCE, ACCEPT = 3, 3, 0.8, 0.9
#: Characters on either side of a span that its contexts are looked for in, one after the other; then the whole text.
REACHES = (60, 600, 6000)
#: Tokens that seed contexts by their shape, as keys and hashes do: at least so long, of at least so many different characters.
KEY_LENGTH, KEY_VARIETY = 20, 10
SPACE = r"\x20\x09-\x0D"
#: Stands for an inner dot or separator while a pattern is matched; where a text has it, another one stands for it.
MARK, OTHER = "", ""


def _spans(text: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive), value of the leftmost non-overlapping matches, from the pieces around them."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        return F.struct(F.coalesce(end, start).alias("at"),
                        F.when(pair["hit"].isNull(), done["out"]).otherwise(
                            F.concat(done["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("value"))))).alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, begin, step, lambda x: x["out"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn test: from the right, every second is doubled and its digits are added."""
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(places, F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def base_spans(text: Column) -> Column:
    """kind (place in KINDS), start, end, value of every email, ip, card and phone of a text.

    The patterns are written without nested repetition, so very long runs cost linear time and no deep recursion: inner
    dots of domains and single separators between digits are marked first, one character for one.
    """
    clean = F.translate(text, MARK, OTHER)
    local = rf"A-Za-z0-9._%+\-{MARK}"
    dotted = F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    email = F.when(text.contains("@"), _spans(dotted, rf"(?:\G|(?<![{local}]))[{local}]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9\-{MARK}]++"))
    ip = F.when(text.contains("."), _spans(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"))
    ip = F.filter(ip, lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.expr("true") & (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                                         & (F.coalesce(F.right(p, F.lit(4)).cast("int"), F.lit(0)) <= 255)))
    joined = F.regexp_replace(clean, r"(?<=[0-9])[ -](?=[0-9])", MARK)
    card = _spans(joined, rf"[0-9][0-9{MARK}]{{12,}}+")
    card = F.filter(card, lambda s: F.when(F.length(_digits(s["value"])).between(13, 19), _luhn(_digits(s["value"]))).otherwise(False))
    phone = F.when(text.contains("+"), _spans(text, r"\+[0-9][\x20().0-9-]+[0-9]"))
    phone = F.filter(phone, lambda s: F.length(_digits(s["value"])).between(9, 15))

    def of(kind: int, spans: Column) -> Column:
        empty = F.array().cast("array<struct<kind:int,start:int,end:int>>")
        return F.coalesce(F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), empty)
    return F.concat(*(of(i, spans) for i, spans in enumerate((email, ip, card, phone))))


def _candidates(text: Column) -> Column:
    """start, end, value of tokens shaped like identifiers: at least six letters or digits, two digits among them."""
    tokens = _spans(text, rf"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+")

    def trimmed(s: Column) -> Column:
        head = F.length(s["value"]) - F.length(F.regexp_replace(s["value"], r"^[^A-Za-z0-9]++", ""))
        inner = F.regexp_replace(F.regexp_replace(s["value"], r"^[^A-Za-z0-9]++", ""), r"[^A-Za-z0-9]++$", "")
        return F.struct((s["start"] + head).alias("start"), (s["start"] + head + F.length(inner)).alias("end"), inner.alias("value"))
    shaped = F.filter(F.transform(tokens, trimmed), lambda s: (F.length(_digits(s["value"])) >= 2)
                      & (F.length(F.regexp_replace(s["value"], "[^A-Za-z0-9]", "")) >= 6))
    return F.coalesce(shaped, F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _key_like(value: Column) -> Column:
    """Whether a value looks drawn at random: one long piece of letters and digits, both of them, with many different characters."""
    return (value.rlike(rf"^[A-Za-z0-9+/_=-]{{{KEY_LENGTH},}}$") & value.rlike("[A-Za-z]") & (F.length(_digits(value)) * 8 >= F.length(value))
            & (F.size(F.array_distinct(F.split(F.lower(value), ""))) >= KEY_VARIETY))


def _words_before(text: Column, start: Column) -> Column:
    """The words before a place, at least the last two of them whole: further back is looked only where the near part holds less."""
    def words(reach: Column) -> Column:
        return F.filter(F.split(F.lower(F.substring(text, start - reach + 1, reach)), rf"[^\p{{L}}\p{{N}}=:@]+"), lambda w: w != "")
    found = words(start)
    for reach in reversed(REACHES):
        near = words(F.least(start, F.lit(reach)))
        found = F.when((start <= reach) | (F.size(near) > 2), near).otherwise(found)
    return found


def _word_after(text: Column, end: Column) -> Column:
    """The first word after a place, whole."""
    left = F.length(text) - end
    found = F.regexp_extract(F.substring(text, end + 1, left), r"[\p{L}\p{N}]+", 0)
    for reach in reversed(REACHES):
        near = F.substring(text, end + 1, F.lit(reach))
        found = F.when(left <= reach, F.regexp_extract(near, r"[\p{L}\p{N}]+", 0)).when(
            near.rlike(r"[\p{L}\p{N}][^\p{L}\p{N}]"), F.regexp_extract(near, r"[\p{L}\p{N}]+", 0)).otherwise(found)
    return F.lower(found)


def _contexts(text: Column, start: Column, end: Column) -> Column:
    """The lexical patterns around a span: two words before it, the word on either side."""
    def patterns(words: Column) -> Column:
        last = F.coalesce(F.get(words, F.size(words) - 1), F.lit(""))
        second = F.coalesce(F.get(words, F.size(words) - 2), F.lit(""))
        return F.array(F.concat(F.lit("2 "), second, F.lit(" "), last, F.lit(" _")), F.concat(F.lit("1 "), last, F.lit(" _ "), _word_after(text, end)))
    return F.get(F.transform(F.array(_words_before(text, start)), patterns), F.lit(0))


def _accepted(edges: DataFrame) -> DataFrame:
    """The unseen values that high-confidence contexts hold: value, score.

    edges(pattern, value, known, base) is the graph; known values are the base matches and what is shaped like a key, which has to
    stand in trusted contexts itself to be accepted. A context is worth the mean score of its distinct values, damped by one
    unknown; a value is worth what all its trusted contexts leave of doubt. Seeds stay at one; each round lets values
    found so far support further contexts. Both sides fold before they are shuffled.
    """
    scores = edges.where(~F.col("base")).select("value").distinct().withColumn("score", F.lit(0.0))
    for _ in range(ROUNDS):
        weighed = edges.join(scores, "value", "left").withColumn("s", F.when(F.col("known"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        patterns = weighed.groupBy("pattern").agg(F.sum("s").alias("sum"), F.count(F.lit(1)).alias("n"), F.sum((F.col("s") >= ACCEPT).cast("int")).alias("support"))
        patterns = patterns.withColumn("confidence", F.col("sum") / (F.col("n") + 1)).where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        scores = stored(edges.where(~F.col("base")).join(patterns.select("pattern", "confidence"), "pattern")
                        .groupBy("value").agg((1 - F.exp(doubt)).alias("score")))
    return scores.where(F.col("score") >= ACCEPT)


def _listed(spans: Column) -> Column:
    """kind:start:end of spans by kind, start and end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_id, base_sha256, spans, base (array of kind, start, end), found (array) per row.

    Emails, addresses, card numbers and phone numbers are matched wherever they stand and seed the context graph, and so do
    tokens shaped like keys; tokens shaped like identifiers that overlap no base match and stand in trusted contexts are added
    as kind id. Null texts count
    as empty and have no spans. Equal texts get equal spans; rows are neither merged nor dropped; an empty table gives no
    rows; further columns play no part.
    """
    body = F.col("text")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = rows.select("doc_id", "text", base_spans(body).alias("base"), _candidates(body).alias("tokens"))
    apart = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    seeds = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"),
                                                   F.substring(body, b["start"] + 1, b["end"] - b["start"]).alias("value"), F.lit(True).alias("known"),
                                                   F.lit(True).alias("is_base"), _contexts(body, b["start"], b["end"]).alias("patterns")))
    unseen = F.transform(apart, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"),
                                                   _key_like(t["value"]).alias("known"), F.lit(False).alias("is_base"), _contexts(body, t["start"], t["end"]).alias("patterns")))
    rows = stored(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "base", F.concat(seeds, unseen).alias("instances")))
    flat = rows.where(F.size("instances") > 0).select("row", F.inline("instances"))
    edges = stored(flat.select(F.explode("patterns").alias("pattern"), "value", "known", F.col("is_base").alias("base"))
                   .groupBy("pattern", "value").agg(F.max("known").alias("known"), F.max("base").alias("base")))
    found = flat.where(~F.col("is_base")).join(_accepted(edges).select("value"), "value", "left_semi")
    lists = found.groupBy("row").agg(F.collect_list(F.struct(F.lit(KINDS.index("id")).alias("kind"), "start", "end")).alias("found"))
    full = rows.select("row", "doc_id", "base").join(lists, "row", "left")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    full = full.withColumn("found", F.coalesce("found", none))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return full.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.size("found").cast("long").alias("n_id"),
                       F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "found")).alias("spans"), "base", "found")
