"""Personal data (operator 9). Built-in functions only.

Regular expressions propose spans, validators confirm them: octets of at most 255, Luhn's sum for
cards, 97 as the modulus of account numbers, digit counts for phones. Each confirmed span has a score
that rises when a word typical of its kind stands within ``NEAR`` characters before it. Kinds with a
checksum stand on their own; national numbers have none and count only with such a word.

A pattern that could run over the same characters again and again starts only where its run of
characters starts (or the last match ended), and repeats possessively: the matches are the same, in
linear time and without deep recursion on very long runs. Positions are running totals over the
pieces between matches, and context is cut from blocks of the text, so a text with very many matches
costs little more than its length.

Account numbers end at their country's length, whatever follows, and may be printed in groups of four.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skytrace.llm.sqltext import blocks, cut, found, let, running, total

NEAR = 40
ENOUGH = 0.5


# Public lengths of account numbers by country. Other countries: 15 to 34 characters in one run.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def _account_pattern() -> str:
    def of(size: int, countries: str) -> str:
        groups, rest = divmod(size - 4, 4)
        tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{tail}"

    return "|".join([*(of(n, c) for n, c in ACCOUNT_LENGTHS.items()), r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"])


class Kind(NamedTuple):
    name: str
    pattern: str
    plain: str  # the same for engines without possessive repeats
    score: float  # of a confirmed span without context
    context: str
    may: str  # texts without a match of this can't have the kind


KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0.9, "mail|contact|write", "@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0.6, "ip|addr|host|server", r"[0-9]\.[0-9]"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+", 0.7, "card|visa|credit|pay", "[0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "tel|phone|call|mobile|fax", r"\+[0-9]"),
    Kind("iban", _account_pattern(), _account_pattern(), 0.8, "iban|account|bank|konto", "[A-Z]{2}[0-9]{2}"),
    Kind("national_id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3, "ssn|social|security|national", "[0-9]-[0-9]{2}-[0-9]"),
]
BASE = ["email", "ip", "card", "phone"]
OCTET = r"0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    """Digits as text; every second from the right counts double, less 9 above 9."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int"))
    ))
    return total(values) % 10 == 0


def _mod97(account: Column) -> Column:
    """The first four characters move to the end, letters count 10 to 35; the remainder must be 1."""
    account = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4))), "")
    letters = lambda c: F.ascii(c) - 55
    step = lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + c.cast("int")).otherwise(acc * 100 + letters(c)) % 97
    return F.aggregate(moved, F.lit(0), lambda acc, c: step(acc, c).cast("int")) == 1


def _confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return _mod97(m) if kind == "iban" else F.lit(True)


def _spans_of(kind: Kind, text: Column, pieces: Column) -> Column:
    def scored(x: Column) -> Column:
        size = F.least(x["start"], F.lit(NEAR))
        near = F.lower(cut(pieces, x["start"] - size, size)).rlike(rf"\b({kind.context})")
        score = F.when(near, F.least(F.lit(kind.score + 0.3), F.lit(1.0))).otherwise(F.lit(kind.score))
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), score.alias("score"))

    hits = F.transform(F.filter(found(text, kind.pattern), lambda x: _confirmed(kind.name, x["m"])), scored)
    if kind.name not in BASE:
        hits = F.filter(hits, lambda s: s["score"] >= ENOUGH)
    some = F.contains(text, F.lit("@")) if kind.may == "@" else text.rlike(kind.may)
    return F.when(some, hits).otherwise(F.array().cast("array<struct<kind:string,start:long,end:long,score:double>>"))


def spans(text: Column, pieces: Column) -> Column:
    """Confirmed spans as ``array<struct<kind, start, end, score>>`` by kind as listed, then start."""
    return F.concat(*[_spans_of(k, text, pieces) for k in KINDS])


def _listed(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_spans(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as struct ``row``, its text as ``t`` (null: empty) and ``found`` spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.struct("*").alias("row"), text.alias("t"))
    return df.withColumn("found", let(blocks(F.col("t")), lambda pieces: spans(F.col("t"), pieces)))


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans per row of ``docs(doc_id, text, ...)``.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base kinds' spans as
    ``kind:start:end``, comma-joined), spans (of all kinds), n_iban, n_national_id. Offsets count code
    points, ends are exclusive. Null and empty texts have no spans and the hash of the empty text.
    Repeated rows are each returned; other columns are ignored; an empty table gives an empty result.
    """
    df = with_spans(docs.select(F.col("doc_id"), F.col("text"))).select("row.doc_id", "found")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(BASE))
    return df.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
        count("iban"), count("national_id"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars``, if there, follows the new text.

    Of overlapping spans the one that starts first (then the longest) gives the name, and all their
    characters go. Rows without spans keep their text, also null.
    """
    df = with_spans(docs)
    order = F.sort_array(F.transform("found", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def replaced(spans: Column, pieces: Column, ends: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0).cast("long"))
        mark = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        # a span that starts inside earlier ones adds nothing
        parts = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(cut(pieces, before(i), s["start"] - before(i)), mark(s))).otherwise(""))
        last = before(F.size(ends))
        return F.concat(F.array_join(parts, ""), cut(pieces, last, F.length("t") - last))

    new = let(order, lambda o: let(running(F.transform(o, lambda s: -s["back"]), F.greatest), lambda e: let(blocks(F.col("t")), lambda p: replaced(o, p, e))))
    df = df.withColumn("new", F.when(F.size("found") == 0, F.col("row.text")).otherwise(new))
    changed = {"text": F.col("new"), "n_chars": F.when(F.size("found") == 0, F.col("row.n_chars")).otherwise(F.length("new"))} if "n_chars" in docs.columns else {"text": F.col("new")}
    kinds = dict(docs.dtypes)
    return df.select(*[(changed[c].cast(kinds[c]) if c in changed else F.col("row")[c]).alias(c) for c in docs.columns])


def _sql_kind(k: Kind) -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    checks = {
        "ip": rf"regexp_full_match(m, '{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}')",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: "
        f"CASE WHEN i % 2 = 1 THEN reverse({digits})[i]::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][reverse({digits})[i]::INT + 1] END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": "list_reduce(list_prepend(0, list_transform(string_split(substring(replace(m, ' ', ''), 5) || substring(m, 1, 4), ''), lambda c: "
        "CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1",
    }
    near = rf"regexp_matches(lower(substring(t, greatest(s - {NEAR} + 1, 1), least(s, {NEAR}))), '\b({k.context})')"
    keep = "" if k.name in BASE else f" AND {k.score} + CASE WHEN {near} THEN 0.3 ELSE 0 END >= {ENOUGH}"
    return rf"""
  SELECT rid, {KINDS.index(k)} AS o, '{k.name}' AS kind, s, s + length(m) AS e FROM (
    SELECT rid, t, ms[i] AS m, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::BIGINT AS s
    FROM (SELECT rid, t, regexp_extract_all(t, '{k.plain}') AS ms, string_split_regex(t, '{k.plain}') AS ps FROM d), unnest(range(1, len(ms) + 1)) AS u(i))
  WHERE {checks.get(k.name, "TRUE")}{keep}"""


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_sql_kind(k) for k in KINDS)}),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in [*BASE, "iban", "national_id"])},
             coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (o < {len(BASE)}), '') AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans
      FROM f GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_iban, 0) AS n_iban, coalesce(n_national_id, 0) AS n_national_id
FROM d LEFT JOIN g USING (rid)
"""
