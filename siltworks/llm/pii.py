"""Personal data by regular expressions, checksums and context words, in DataFrame functions alone.

Each kind has a pattern that proposes spans (leftmost, not overlapping within a
kind) and a validator that confirms them: numbers of an IP address up to 255, the
Luhn sum of a card, the number of a phone's digits, ISO 7064 mod 97-10 of an
IBAN, letters and digits in a secret of 20 characters or more.  An IBAN ends at its country's length; those of countries without a known
length take all upper-case letters and digits that follow.  A failed span is dropped without another try inside it.  Every span has a
score: the kind's base value plus ``CONTEXT_BONUS`` where one of the kind's
context words stands within ``CONTEXT_CHARS`` characters before or after it, up to
the next match of the kind's pattern.  The
base kinds (email, ip, card, phone) are found whatever their score; the others
need ``LEAST_SCORE``, so a secret is one only by its context.

Spans are found by one ``regexp_replace`` a kind that puts a control character
around each match, and one ``split`` at it; running lengths give the places.  A
text's own uses of that character are first replaced by another one, neither of
which any pattern takes.  Patterns repeat single character classes only, never
groups, so long texts need neither stack nor backtracking: separators or dots that
the grammar doesn't allow in a span are first replaced, one character by one.

Cases: a null text is empty and has no spans; a null ``doc_id`` stays; repeated
rows each give a row; an empty table gives no rows; columns named like the
results are replaced, others are kept out of the way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans at one place are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret")
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.6, "phone": 0.5, "iban": 0.8, "secret": 0.4}
CONTEXT = {
    "email": "mail|e-mail|email|contact|write to",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|mastercard|credit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|telefon",
    "iban": "iban|account|bank|transfer|konto|cuenta|compte",
    "secret": "token|secret|password|passwd|pwd|credentials?|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer",
}
CONTEXT_CHARS, CONTEXT_BONUS = 40, 0.2
#: Spans of the kinds that the method adds need this score; base spans always stay.
LEAST_SCORE = 0.6
#: Lengths of IBANs by country, and their countries.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_MARK, _OTHER, _BREAK = "\x01", "\x02", "\x03"


#: Parts of a split text that are summed up together; an even number, so that a block's odd parts are matches.
_BLOCK = 256
_NO_SPANS = "array<struct<start:int,stop:int,value:string,near:string>>"


def _marked(text: Column, pattern: str) -> Column:
    """Structs (start, stop, value, near) of a pattern's matches in ``text``, which holds no mark; ``near`` is the text around.

    Running lengths give the places, first within blocks of parts, then over the
    blocks, so that the time is in proportion to the matches.
    """
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_NO_SPANS).alias("spans"))

    def walked(parts: Column, first: Column) -> Column:
        """The length of a block of parts and its spans; odd parts are matches."""
        return F.aggregate(
            F.transform(F.slice(parts, first + 1, _BLOCK), lambda p, i: F.struct(p.alias("p"), (first + i).alias("i"))),
            empty,
            lambda a, x: F.struct((a["at"] + F.length(x["p"])).alias("at"), F.when(x["i"] % 2 == 1, F.concat(a["spans"], F.array(span(parts, a["at"], x)))).otherwise(a["spans"]).alias("spans")),
        )

    def span(parts: Column, at: Column, x: Column) -> Column:
        near = F.concat(F.right(F.get(parts, x["i"] - 1), F.lit(CONTEXT_CHARS)), F.lit("\n"), F.left(F.get(parts, x["i"] + 1), F.lit(CONTEXT_CHARS)))
        return F.struct(at.alias("start"), (at + F.length(x["p"])).alias("stop"), x["p"].alias("value"), near.alias("near"))

    def placed(parts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _BLOCK).cast("int")), lambda i: walked(parts, i * _BLOCK))
        return _let(blocks, lambda x: _let(F.aggregate(x, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + b["at"]))), lambda at: moved(x, at)))

    def moved(blocks: Column, before: Column) -> Column:
        spans = F.zip_with(blocks, before, lambda b, at: F.transform(b["spans"], lambda s: F.struct((s["start"] + at).alias("start"), (s["stop"] + at).alias("stop"), s["value"].alias("value"), s["near"].alias("near"))))
        return F.flatten(F.filter(spans, lambda x: x.isNotNull()))

    # texts without a match, most of them, take no walk
    return _let(parts, lambda x: F.when(F.size(x) > 1, placed(x)).otherwise(F.array().cast(_NO_SPANS)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    total = F.aggregate(
        F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.struct(c.cast("int").alias("d"), (i % 2).alias("odd"))),
        F.lit(0),
        lambda a, x: a + F.when(x["odd"] == 0, x["d"]).when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2),
    )
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN (upper case, spaces removed) leaves 1 modulo 97."""
    turned = F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _small_number(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))


def _find(kind: str, text: Column) -> Column:
    """Confirmed spans of a kind."""
    if kind == "email":
        # a dot that isn't between two characters of a host name can't be in one
        t = F.regexp_replace(text, r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])", _BREAK)
        local = rf"A-Za-z0-9._%+\x03-"
        found = _marked(t, rf"(?:(?<![{local}])|\G)[{local}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++")
        return F.when(F.contains(text, F.lit("@")), found)
    if kind == "ip":
        found = _marked(text, r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
        return F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(found, lambda s: F.forall(F.split(s["value"], r"\."), _small_number)))
    if kind == "card":
        # a separator that isn't between two digits ends a number
        t = F.regexp_replace(text, "(?<![0-9])[ -]|[ -](?![0-9])", _BREAK)
        digits = lambda s: _digits(s["value"])
        found = F.filter(_marked(t, "[0-9][0-9 -]++"), lambda s: F.length(digits(s)).between(12, 19) & luhn(digits(s)))
        return F.when(text.rlike("[0-9](?:[ -]?[0-9]){11}"), found)
    if kind == "phone":
        found = _marked(text, r"\+[0-9][ ().0-9-]+[0-9]")
        return F.when(text.rlike(r"\+[0-9]"), F.filter(found, lambda s: F.length(_digits(s["value"])).between(9, 15)))
    if kind == "iban":
        t = F.regexp_replace(text, "(?<![A-Z0-9]) | (?![A-Z0-9])", _BREAK)
        plain = lambda s: F.replace(s["value"], F.lit(" "), F.lit(""))
        sized = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}} ?[A-Z0-9]{{4}}{' ?[A-Z0-9]' * (n - 8)}" for n, c in IBAN_LENGTHS.items())
        known = F.filter(_marked(t, f"(?<![A-Za-z0-9])(?:{sized})(?![A-Za-z0-9])"), lambda s: mod97(plain(s)))
        countries = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
        others = _marked(t, f"(?<![A-Za-z0-9])(?!{countries})[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}}[A-Z0-9 ]{{7,36}}(?![A-Za-z0-9])")
        others = F.filter(others, lambda s: F.length(plain(s)).between(15, 34) & mod97(plain(s)) & ~F.exists(known, lambda k: (k["start"] < s["stop"]) & (s["start"] < k["stop"])))
        found = F.concat(known, others)
        return F.when(text.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), found)
    if kind == "secret":
        found = _marked(text, "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+")
        return F.when(text.rlike("[A-Za-z0-9+/_-]{20}"), F.filter(found, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")))
    raise ValueError(kind)


def _scored(no: int, kind: str, found: Column) -> Column:
    """A kind's spans with its number and score."""

    def one(s: Column) -> Column:
        bonus = F.when(F.lower(s["near"]).rlike(rf"(?<![a-z0-9])(?:{CONTEXT[kind]})(?![a-z0-9])"), CONTEXT_BONUS).otherwise(0.0)
        fields = {"start": s["start"], "kind_no": F.lit(no), "stop": s["stop"], "kind": F.lit(kind), "value": F.translate(s["value"], _BREAK, "."), "score": F.round(F.lit(BASE_SCORE[kind]) + bonus, 2)}
        return F.struct(*(v.alias(k) for k, v in fields.items()))

    scored = F.transform(found, one)
    return scored if kind in BASE_KINDS else F.filter(scored, lambda x: x["score"] >= LEAST_SCORE)


def _unused(df: DataFrame) -> str:
    """A prefix that no column has."""
    mine = "__"
    while any(c.startswith(mine) for c in df.columns):
        mine += "_"
    return mine


def find_pii(docs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``docs`` (doc_id, text) with ``pii``: an array of (start, stop, kind_no, kind, value, score), by start, then kind.

    Places are in code points, ``stop`` is exclusive.  A former column ``pii`` is
    replaced; all others stay.
    """
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), f"{_MARK}{_BREAK}", _OTHER * 2)
    mine = _unused(docs)
    df = docs.drop("pii").withColumn(f"{mine}t", text)
    none = F.array().cast(_NO_SPANS)
    for k in kinds:
        df = df.withColumn(f"{mine}{k}", F.coalesce(_find(k, F.col(f"{mine}t")), none))
    found = [_scored(no, k, F.col(f"{mine}{k}")) for no, k in enumerate(KINDS) if k in kinds]
    return df.withColumn("pii", F.array_sort(F.concat(*found))).drop(f"{mine}t", *(f"{mine}{k}" for k in kinds))


def redact(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """``docs`` with each span of at least that score replaced by ``<KIND>``; spans that overlap an earlier one are skipped."""
    df, work = find_pii(docs), f"{_unused(docs)}w"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    walked = F.aggregate(
        F.filter(F.col("pii"), lambda s: s["score"] >= least),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(s["stop"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out")),
        ).otherwise(a),
    )
    return df.withColumn(work, walked).withColumn("text", F.concat(F.col(f"{work}.out"), F.substring(text, F.col(f"{work}.at") + 1, F.length(text)))).drop(work, "pii")


def as_text(spans: Column) -> Column:
    """``kind:start:stop`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, counts of the base kinds, base_sha256, spans, scores."""
    df = find_pii(docs)
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind_no"] < len(BASE_KINDS))
    return df.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"))
