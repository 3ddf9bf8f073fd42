"""Filters, keys and token shaping of a labelled corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import uniform
from ..sources.tables import kept


def usable(df: DataFrame, *flags: str) -> DataFrame:
    """Rows whose flags are all true."""
    return df.where(reduce(lambda a, b: a & b, (F.coalesce(F.col(f), F.lit(False)) for f in flags)))


def before_after(df: DataFrame, *flags: str) -> DataFrame:
    """Rows before and after :func:`usable`, in one pass."""
    ok = reduce(lambda a, b: a & b, (F.coalesce(F.col(f), F.lit(False)) for f in flags))
    return df.agg(F.count("*").alias("n_before"), F.count_if(ok).alias("n_after"))


def binarised(*counts: str) -> list[Column]:
    """Counts as 0/1 flags; null is 0."""
    return [(F.coalesce(F.col(c), F.lit(0)) > 0).cast("int").alias(c) for c in counts]


def admitted(df: DataFrame, name: str, size: str, extensions: list[str], low: int, high: int) -> DataFrame:
    """Files of the given extensions with a size strictly between the bounds."""
    pattern = r"\.(" + "|".join(extensions) + ")$"
    return df.where(F.lower(F.col(name)).rlike(pattern) & (F.col(size) > low) & (F.col(size) < high))


def without_matching(df: DataFrame, items: Column, pattern: str) -> DataFrame:
    """Rows none of whose items matches."""
    return df.where(~F.exists(items, lambda x: x.rlike(pattern)))


def group_key(path: Column, prefix: Column) -> Column:
    """Lower-case base name without archive suffix, leading uuid and commas, after a source prefix."""
    base = F.lower(F.substring_index(path, "/", -1))
    base = F.regexp_replace(base, r"\.(z|gz)$", "")
    base = F.regexp_replace(base, r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}_?", "")
    return F.concat(prefix, F.lit(":"), F.regexp_replace(base, ",", "_"))


def key_shape(df: DataFrame, key: str, pattern: str = "^[0-9a-f]{64}$") -> DataFrame:
    """How many keys have the right shape."""
    good = F.coalesce(F.col(key).rlike(pattern), F.lit(False))
    return df.agg(F.count("*").alias("n"), F.count_if(good).alias("n_good"), F.round(F.avg(good.cast("double")), 6).alias("ratio"))


def offenders(df: DataFrame, key: str, pattern: str = "^[0-9a-f]{64}$", n: int = 10) -> DataFrame:
    """The first keys of the wrong shape, a report of fixed length."""
    return df.where(~F.coalesce(F.col(key).rlike(pattern), F.lit(False))).select(key).orderBy(key).limit(n)


def masked_bytes(content: Column, *spans: tuple[int, int]) -> Column:
    """``content`` (binary) with byte spans (offset from 0, length) set to zero, where it is long enough."""
    out = content
    for at, n in spans:
        zero = F.lit(bytearray(n))
        out = F.when(F.octet_length(content) >= at + n, F.overlay(out, zero, at + 1, n)).otherwise(out)
    return out


def machine_field(content: Column) -> Column:
    """The 16-bit little-endian machine field of a header whose offset stands at byte 60; null if there is none."""
    byte = lambda at: F.conv(F.hex(F.substring(content, at + 1, 1)), 16, 10).cast("int")
    offset = byte(60) + byte(61) * 256
    here = F.conv(F.concat(F.hex(F.substring(content, offset + 6, 1)), F.hex(F.substring(content, offset + 5, 1))), 16, 10).cast("int")
    return F.when((F.octet_length(content) >= 64) & (F.substring(content, 1, 2) == F.lit(bytearray(b"MZ"))) & (F.substring(content, offset + 1, 2) == F.lit(bytearray(b"PE"))), here)


# Fixed values of the executable header: where its offset stands, and the two fields, the magics and the machines.
_OFFSET_AT, _OPTIONAL, _SUBSYSTEM = 0x3C, 24, 0x44
_MACHINES = {0x10B: 0x14C, 0x20B: 0x8664}


def little(content: Column, at: Column | int, size: int) -> Column:
    """The unsigned little-endian number of ``size`` bytes at offset ``at``; null where the content ends before."""
    start = F.lit(at) if isinstance(at, int) else at
    byte = lambda k: F.hex(F.substring(content, (start + (k + 1)).cast("int"), F.lit(1)))
    digits = F.concat(*(byte(k) for k in reversed(range(size))))
    return F.when(F.octet_length(content) >= start + size, F.conv(digits, 16, 10).cast("long"))


def header_offset(content: Column) -> Column:
    """Where the header of an executable begins, by the offset in the content itself; null if there is no whole header."""
    offset = little(content, _OFFSET_AT, 4)
    whole = (F.substring(content, 1, 2) == F.lit(bytearray(b"MZ"))) & (offset + _OPTIONAL + _SUBSYSTEM + 2 <= F.octet_length(content))
    # the offset fits an int where the header lies within the content
    signature = F.substring(content, F.when(whole, offset + 1).otherwise(1).cast("int"), F.lit(4)) == F.lit(bytearray(b"PE\0\0"))
    return F.when(whole & signature, offset)


def _patched(content: Column, at: Column, value: bytes) -> Column:
    return F.overlay(content, F.lit(bytearray(value)), (at + 1).cast("int"), F.lit(len(value)))


def model_view(content: Column) -> Column:
    """An executable with its machine and subsystem fields set to zero, the same for every class; null if it has no header."""
    at = header_offset(content)
    return F.when(at.isNotNull(), _patched(_patched(content, at + 4, bytes(2)), at + (_OPTIONAL + _SUBSYSTEM), bytes(2)))


def analysis_view(content: Column) -> Column:
    """An executable whose zeroed machine field is restored from the header's magic, where that is known; null if it has no header."""
    at = header_offset(content)
    machine, magic = little(content, at + 4, 2), little(content, at + _OPTIONAL, 2)
    out = content
    for known, value in _MACHINES.items():
        out = F.when((machine == 0) & (magic == known), _patched(content, at + 4, value.to_bytes(2, "little"))).otherwise(out)
    return F.when(at.isNotNull(), out)


def normal_operand(kind: Column, value: Column, base: Column, scale: Column, disp: Column, least: int = -5000, most: int = 5000) -> Column:
    """One operand as text: registers by name, small immediates in hex, others ``HIMM``, memory by its parts; null for other kinds.

    Memory without a base, or of base 0, is ``[MEM]``; a missing scale is 1, a missing displacement 0.
    """
    small = value.try_cast("bigint")
    number = F.when(small.between(least, most), F.concat(F.when(small < 0, "-").otherwise(""), F.lit("0x"), F.lower(F.hex(F.abs(small))))).otherwise("HIMM")
    parts = F.concat(F.lit("["), base, F.lit("*"), F.coalesce(scale, F.lit(1)).cast("string"), F.lit("+"), F.coalesce(disp, F.lit(0)).cast("string"), F.lit("]"))
    memory = F.when(base.isNull() | (base == "0"), F.lit("[MEM]")).otherwise(parts)
    return F.when(kind == "reg", value).when(kind == "imm", number).when(kind == "mem", memory)


def normal_instruction(mnemonic: Column, operands: Column, prefix: str = "X_") -> Column:
    """An instruction as one token: operand structs (type, value, base, scale, disp), each after a space, commas between, spaces as underscores."""
    parts = F.transform(operands, lambda o: F.coalesce(F.concat(F.lit(" "), normal_operand(o["type"], o["value"], o["base"], o["scale"], o["disp"])), F.lit("")))
    return F.concat(F.lit(prefix), F.replace(F.concat(mnemonic, F.coalesce(F.array_join(parts, ","), F.lit(""))), F.lit(" "), F.lit("_")))


def bucketed_number(token: Column, most: int = 5000) -> Column:
    """Numbers up to ``most`` as they are, larger ones ``HIMM``, other tokens lower-cased."""
    digits = token.rlike("^[0-9]+$")
    short = F.length(token) <= len(str(most))
    return F.when(digits & short & (F.when(digits & short, token).cast("int") <= most), token).when(digits, "HIMM").otherwise(F.lower(token))


def padded(items: Column, n: int) -> tuple[Column, Column]:
    """The first ``n`` items padded with zeros, and how many are real."""
    return F.slice(F.concat(F.slice(items, 1, n), F.array_repeat(F.lit(0).cast("long"), n)), 1, n), F.least(F.size(items), F.lit(n))


#: Vocabularies of up to so many rows are sent to all tasks.
SENT_ROWS = 200_000


def encode(tokens: DataFrame, vocabulary: DataFrame, unknown: int) -> DataFrame:
    """(doc, pos, token) as ids by document in order, with the unknown ones' count; the vocabulary is (token, id).

    A vocabulary of up to ``SENT_ROWS`` rows goes to the tokens, so they are shuffled
    once, back to their documents; a larger one meets them by a join on the token.
    """
    vocabulary = kept(vocabulary, "vocabulary")
    small = vocabulary.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    known = tokens.join(F.broadcast(vocabulary) if small else vocabulary, "token", "left").withColumn("id", F.coalesce("id", F.lit(unknown)))
    return known.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("ids"), F.count("*").alias("n_tokens"), F.count_if(F.col("id") == unknown).alias("n_unknown"))


def expert_dropout(mask: Column, key: Column, p: float, seed: str) -> Column:
    """Each available expert dropped with probability ``p``; all dropped restores the mask."""
    kept = F.transform(mask, lambda m, i: F.when(uniform(seed, key, i) < p, 0.0).otherwise(m))
    return F.when(F.exists(kept, lambda x: x > 0), kept).otherwise(mask)
