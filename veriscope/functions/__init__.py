"""Column functions: parsing, guarded arithmetic, rules, hashing. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


# Parsing


def parse_any(c) -> Column:
    """Text to double; NaN and infinities stay."""
    return F.expr("try_cast({} as double)".format(c)) if isinstance(c, str) else c.try_cast("double")


def finite(c) -> Column:
    """A double, or null where it is NaN or infinite."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def parse_finite(c) -> Column:
    """Text to a finite double, else null."""
    return finite(parse_any(c))


def parse_whole(c) -> Column:
    """Text such as ``8.0`` to int."""
    return parse_any(c).try_cast("int")


def parse_flag(c) -> Column:
    """``true``, ``1`` or ``yes`` in any case, with blanks around."""
    return F.lower(F.trim(col(c))).isin("true", "1", "yes")


def first_filled(*cs) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in cs])


def code_list(c) -> Column:
    """Codes divided by ``,`` or ``;``: trimmed, distinct, sorted, blanks dropped."""
    parts = F.transform(F.split(F.translate(col(c), ",", ";"), ";"), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def token_set(c) -> Column:
    """Upper-cased runs of letters and digits, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.upper(col(c)), "[^A-Z0-9]+"), lambda x: x != "")))


def after_colon(c) -> Column:
    """Text after the first colon; all of it where there is none."""
    return F.regexp_replace(col(c), "^[^:]*:", "")


def before_colon(c) -> Column:
    return F.substring_index(col(c), ":", 1)


def record_name(c, prefix: str = "HR", width: int = 5) -> Column:
    """Prefix and zero-padded number; longer numbers are not cut."""
    s = col(c).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0")))


# Arithmetic


def wrapped_angle(a, b) -> Column:
    """Smallest angle between two directions in degrees."""
    return F.abs(F.pmod(col(a) - col(b) + 180, F.lit(360)) - 180)


def signed_absmax(*cs) -> Column:
    """The value of largest size with its sign; the first of equals; nulls don't count."""
    values = F.filter(F.array(*[col(c) for c in cs]), lambda x: x.isNotNull())
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull() | (F.abs(x) > F.abs(a)), x).otherwise(a))


def ratio(n, d, least: float = 1e-12) -> Column:
    """A quotient; null where the denominator is as good as zero."""
    return F.when(F.abs(col(d)) > least, col(n) / col(d))


def sigmoid(x, bound: float = 50.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(col(x), F.lit(bound)), F.lit(-bound))))


def off_target_index(off, target, form: str = "plain", eps: float = 1e-6) -> Column:
    """Off-target by target effect; ``plain``: eps is added to the target, ``floor``: the target's size is at least eps,
    ``size``: eps is added to the target's size."""
    t = col(target)
    below = {"plain": t + eps, "floor": F.greatest(F.abs(t), F.lit(eps)), "size": F.abs(t) + eps}[form]
    return col(off) / below


def half_up_layer(q, n) -> Column:
    """The layer at relative depth q of n."""
    return F.floor(col(q) * (col(n) - 1) + 0.5).cast("int")


def attenuation(before, after) -> Column:
    return F.abs(col(before)) - F.abs(col(before) - col(after))


# Rules


def all_filled(*cs) -> Column:
    """Whether every value is finite."""
    return reduce(lambda a, b: a & b, [finite(c).isNotNull() for c in cs])


def ladder(*steps: tuple[Column, str], otherwise: str | None) -> Column:
    """The name of the first rule that holds."""
    out = F.when(steps[0][0], steps[0][1])
    for rule, name in steps[1:]:
        out = out.when(rule, name)
    return out.otherwise(otherwise)


def in_range(c, low: float, high: float, size: bool = False) -> Column:
    """Closed range, of the size if asked."""
    c = F.abs(col(c)) if size else col(c)
    return c.between(low, high)


def has_prefix(c, *prefixes: str) -> Column:
    """Whether a code, without dots and in upper case, begins with a prefix."""
    code = F.upper(F.replace(col(c), F.lit("."), F.lit("")))
    return reduce(lambda a, b: a | b, [code.startswith(p) for p in prefixes])


def three_valued(complete, incomplete) -> Column:
    """1 with the complete code, null with the incomplete one only, else 0."""
    return F.when(col(complete), 1).when(col(incomplete), None).otherwise(0)


def joined_reasons(*pairs: tuple[Column, str], sep: str = "+", otherwise: str = "low") -> Column:
    """Names of the rules that hold, joined."""
    text = F.concat_ws(sep, *[F.when(rule, F.lit(name)) for rule, name in pairs])
    return F.when(text == "", otherwise).otherwise(text)


# Hashing


def _share(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10)


def hash_fraction(key, seed: str) -> Column:
    """First 32 bits of SHA-256 of ``seed:key`` as a fraction of their largest value."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), col(key).cast("string")), 256)
    return _share(F.substring(digest, 1, 8)).cast("double") / F.lit(float(0xFFFFFFFF))


def split_by_fraction(key, seed: str = "0", train: float = 0.70, val: float = 0.15) -> Column:
    f = hash_fraction(key, seed)
    return F.when(f < train, "train").when(f < train + val, "val").otherwise("test")


# The salt of the split by tenths.
TENTHS_SALT = "external-head-v1:"


def split_by_tenths(key, salt: str = TENTHS_SALT) -> Column:
    """The first 64 bits of SHA-256, big-endian, modulo 10: 7 parts train, 1 val, 2 test."""
    digits = _share(F.substring(F.sha2(F.concat(F.lit(salt), col(key).cast("string")), 256), 1, 16))
    tenth = F.substring(digits, -1, 1).cast("int")
    return F.when(tenth < 7, "train").when(tenth < 8, "val").otherwise("test")


def _split_by_hundredths(digest: Column) -> Column:
    # A hexadecimal number modulo 100, digit by digit.
    n = F.aggregate(F.split(digest, ""), F.lit(0), lambda a, d: F.when(d == "", a).otherwise((a * 16 + F.conv(d, 16, 10).cast("int")) % 100))
    return F.when(n < 70, "train").when(n < 80, "val").otherwise("test")


def split_sha1(key, salt: str) -> Column:
    return _split_by_hundredths(F.sha1(F.concat(F.lit(salt), col(key).cast("string"))))


def split_md5(key) -> Column:
    return _split_by_hundredths(F.md5(col(key).cast("string")))


def seed_by_first_bytes(text) -> Column:
    """A 32-bit seed: the first four bytes of a SHA-256, most significant first."""
    return F.conv(F.substring(F.sha2(col(text), 256), 1, 8), 16, 10).cast("long")


def seed_by_last_first(text) -> Column:
    """A 32-bit seed: the first eight bytes of a SHA-256, least significant first, modulo 2 ** 32."""
    h = F.sha2(col(text), 256)
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")


def config_hash(*cs) -> Column:
    """SHA-256 of the sorted compact JSON of some columns."""
    return F.sha2(F.to_json(F.struct(*sorted(cs)), {"ignoreNullFields": "false"}), 256)


def year_of(text) -> Column:
    """The year of a text timestamp; null where it is none."""
    return F.year(F.try_to_timestamp(col(text)))


def focus(kind, y, threshold) -> Column:
    """Rows in focus: 1 of a binary target, at or above the threshold of others."""
    return F.when(col(kind) == "binary", col(y) == 1).otherwise(col(y) >= threshold)


def overridden(first: Column, *later: tuple[Column, str]) -> Column:
    """Assignments one after the other: of those whose condition holds the last one stays."""
    out = first
    for condition, value in later:
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out
