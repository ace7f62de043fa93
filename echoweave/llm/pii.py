"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums (Luhn, mod-97) and bounds confirm them, and words near a span move its score.

A regular expression gives no places in Spark, so a text is split at the matches: the lengths of the parts between them
and of the matches add up to the places. Those sums are a window over the rows of one text, so their cost follows the
number of its matches, and no text is shuffled.

The patterns of ``BASE`` find what the contract's find. Repeats are possessive: in each of them what follows a repeat
cannot begin with a character that the repeat takes, so giving characters back never helps. Where a run of characters
fails, each later start within it fails too, so ``email`` and ``ip`` start only at the beginning of a run, or, for
``email``, where the match before it ended (``\\G``). That keeps long runs linear, and Java's matcher off its stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_NAME = r"A-Za-z0-9._%+-"
#: Spans that stand for themselves, in the order of the digests.
BASE: dict[str, str] = {
    "email": rf"(?:\G|(?<![{_NAME}]))[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Proposals of the method: kind and pattern. Their score decides, and a span of the same kind in BASE goes before them.
ADDED: dict[str, tuple[str, str]] = {
    "cards": ("card", r"[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}|[0-9]+"),
    "dialled": ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}"),
    "local": ("phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"),
    "iban": ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"),
}
KINDS = (*BASE, "iban")
#: Characters of an IBAN in each country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
#: Code points on either side of a span that count as near it (no further than the next match of its pattern), and the words there that speak for a kind or against it.
NEAR = 40
FOR = {"card": "card|visa|mastercard|credit|debit|karte|tarjeta|carte", "phone": "phone|tel|call|mobile|cell|fax|telefon|handy|telefono|portable", "iban": "iban|account|bank|konto|cuenta|compte"}
AGAINST = "order|invoice|isbn|serial|tracking|hash|version|id"
#: Scores before the words: with a confirmed checksum, by the form alone with a country code, by the form alone.
CHECKED, DIALLED, FORM = 0.7, 0.7, 0.4
FAVOUR, DISFAVOUR, THRESHOLD = 0.3, 0.3, 0.6

_CELL = "array<struct<source:string,gap:int,head:string,tail:string,match:string>>"


def _cells(text: Column, source: str, pattern: str) -> Column:
    """The parts of a text between the matches of a pattern, each with the match after it; none if nothing matches."""
    cell = lambda gap, match: F.struct(F.lit(source).alias("source"), F.length(gap).alias("gap"), F.left(gap, F.lit(NEAR)).alias("head"), F.right(gap, F.lit(NEAR)).alias("tail"), match.alias("match"))
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), cell)
    return F.when(text.rlike(pattern), parts).otherwise(F.array().cast(_CELL))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit checks the others: every second one from the right doubled, all digits summed, divisible by ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(compact: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 by 97, its first four characters moved to the end and letters as 10 to 35."""
    turned = F.concat(F.substr(compact, F.lit(5)), F.left(compact, F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(c == "", a).when(c.between("0", "9"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _near(words: str) -> Column:
    pattern = rf"(?i)(?:^|[^A-Za-z])(?:{words})(?:$|[^A-Za-z])"
    return F.col("tail").rlike(pattern) | F.col("after").rlike(pattern)


def _valid() -> Column:
    """Whether a base match stands."""
    digits = F.length(_digits(F.col("match")))
    octets = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
    return (
        F.when(F.col("source") == "email", True)
        .when(F.col("source") == "ip", F.col("match").rlike(octets))
        .when(F.col("source") == "card", digits.between(13, 19) & luhn(F.when(digits <= 19, _digits(F.col("match")))))
        .when(F.col("source") == "phone", digits.between(9, 15))
        .otherwise(False)
    )


def _score() -> Column:
    """The score of an added match: form and checksum, then the words near it. Null where its form or its borders are wrong."""
    digits, source = F.length(_digits(F.col("match"))), F.col("source")
    apart = ~F.col("tail").rlike("[A-Za-z0-9]$") & ~F.col("after").rlike("^[A-Za-z0-9]")
    form = (
        F.when((source == "cards") & apart & digits.between(13, 19) & luhn(F.when(digits <= 19, _digits(F.col("match")))), CHECKED)
        .when((source == "dialled") & apart & digits.between(9, 15), DIALLED)
        .when((source == "local") & apart & ~F.col("tail").rlike(r"[+(]?[0-9][\x20).-]*$"), FORM)
        .when((source == "iban") & apart & mod97(F.regexp_replace("match", " ", "")), CHECKED)
    )
    words = F.when(source.isin("cards"), _near(FOR["card"])).when(source == "iban", _near(FOR["iban"])).otherwise(_near(FOR["phone"]))
    return form + F.when(words, FAVOUR).otherwise(0.0) - F.when(_near(AGAINST), DISFAVOUR).otherwise(0.0)


def _country_length() -> Column:
    table = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    return F.try_element_at(table, F.left("match", F.lit(2)))


def _of_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, id, kind, start, end, value, score, base) of all spans, and for each text one row of nulls."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    # the first row of each text has no source: it stays whatever is found
    cells = F.concat(F.array(F.lit(None).cast(_CELL[6:-1])), *[_cells(whole, k, p) for k, p in BASE.items()], *[_cells(whole, k, p) for k, (_, p) in ADDED.items()])
    numbered = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = numbered.select("row", "id", F.posexplode(cells).alias("i", "cell")).select("row", "id", "i", "cell.*").repartition("row")
    along = W.partitionBy("row", "source").orderBy("i")
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("match"), F.lit(0))).over(along.rowsBetween(W.unboundedPreceding, 0))).withColumn("after", F.coalesce(F.lead("head").over(along), F.lit("")))
    placed = placed.where("match is not null or source is null").withColumn("start", F.col("end") - F.length("match"))
    # an IBAN ends where its country says; what the pattern took beyond that stands after it
    own = F.regexp_substr(F.col("match"), F.concat(F.lit("^(?:[A-Z0-9] ?){"), (_country_length() - 1).cast("string"), F.lit("}[A-Z0-9]")))
    own = F.when(F.col("source") == "iban", F.coalesce(own, F.lit(""))).otherwise(F.col("match"))
    placed = placed.withColumn("value", own).withColumn("after", F.concat(F.substr("match", F.length("value") + 1), F.col("after"))).withColumn("match", F.col("value")).withColumn("end", F.col("start") + F.length("value"))
    base = F.col("source").isin(*BASE)
    kind = F.when(base, F.col("source"))
    for source, (name, _) in ADDED.items():
        kind = kind.when(F.col("source") == source, name)
    scored = placed.withColumns({"kind": kind, "base": base, "score": F.when(base, F.when(_valid(), 1.0)).otherwise(_score())}).where((F.col("score") >= THRESHOLD) | F.col("source").isNull())
    # of added spans of one kind that overlap, the first stands, the longest of those; none overlaps a base span
    ordered = W.partitionBy("row", "kind").orderBy("start", F.desc("end"), "source")
    earlier, later = ordered.rowsBetween(W.unboundedPreceding, -1), ordered.rowsBetween(1, W.unboundedFollowing)
    free = (F.coalesce(F.max("end").over(earlier), F.lit(0)) <= F.col("start")) & (F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(later), F.col("end")) >= F.col("end"))
    return scored.withColumn("free", free).where(F.col("base") | F.col("free") | F.col("source").isNull()).select("row", "id", "kind", F.col("start").cast("long"), F.col("end").cast("long"), "value", "score", "base")


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, start, end, value, score, base) of the personal data of every text; places in code points, end exclusive.

    ``base`` spans are those of the contract's patterns (score 1). The method adds cards and phone numbers that stand
    within a longer run of digits which fails as a whole, phone numbers without country code near a word that says so,
    and IBANs. Null and empty texts have none; rows that repeat a key are searched one by one; other columns are not read.
    """
    return _of_texts(docs, key, text).where("kind is not null").select(F.col("id").alias(key), "kind", "start", "end", "value", "score", "base")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row: base spans counted and hashed, all spans listed.

    Each row gives one row, those that repeat a key or have none too; a null text counts as empty and has no spans.
    """
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = _of_texts(docs, key, text).withColumn("at", F.when(F.col("kind").isNotNull(), F.struct(number.alias("k"), "start", "end", "kind", "base")))
    whole = spans.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list("at")).alias("at"))
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("at", lambda x: x["base"])
    counts = [F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return whole.select(F.col("id").alias(key), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("at")).alias("spans"))
