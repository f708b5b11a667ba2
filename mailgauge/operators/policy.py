"""Policy as data: weights and thresholds of each message's profile, from a table of settings, and coercion of values."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgauge.functions.text import strip
from mailgauge.operators.score import Policy

#: Profiles that are broadcast; more are joined by a shuffle.
MOST_PROFILES = 10_000
#: Texts that stand for true and false, for labels of both kinds, and labels without marks between words.
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")
BAD = ("1", "1.0", "phishing", "phish", "spam", "malicious", "true", "yes")
GOOD = ("0", "0.0", "benign", "ham", "legit", "legitimate", "normal", "false", "no")
GOOD_COMPACT, BAD_COMPACT = ("safeemail", "nonphishingemail", "legitemail", "hamemail"), ("phishingemail", "maliciousemail", "spamemail")


def positive_int(raw: Column, otherwise: Column) -> Column:
    """A whole number over 0 of a text, else ``otherwise``."""
    n = F.when(strip(raw).rlike(r"^[+]?[0-9]{1,18}$"), strip(raw).try_cast("bigint"))
    return F.when((n > 0) & (n < 1 << 31), n.cast("int")).otherwise(otherwise)


def number(raw: Column, otherwise: Column) -> Column:
    return F.coalesce(strip(raw).try_cast("double"), otherwise)


def truth(raw: Column, otherwise: Column) -> Column:
    low = F.lower(strip(raw))
    return F.when(low.isin(*TRUE), F.lit(True)).when(low.isin(*FALSE), F.lit(False)).otherwise(otherwise)


def is_true(raw: Column) -> Column:
    return truth(raw, F.lit(False))


def choices(raw: Column) -> Column:
    """The different items of a list by commas, in order; null: none."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), strip), lambda x: x != ""))


def binary_label(raw: Column) -> Column:
    """1 for a label that says phishing, 0 for one that says harmless, null for anything else."""
    text = F.lower(F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), r"(?U)\s+", " "))
    compact = F.regexp_replace(text, r"[^\p{L}\p{N}]", "")
    bad = text.contains("phish") | text.contains("malicious") | text.contains("spam")
    return (
        F.when(text.isin(*BAD), 1).when(text.isin(*GOOD), 0).when(compact.isin(*GOOD_COMPACT), 0).when(compact.isin(*BAD_COMPACT), 1)
        .when(text.contains("safe"), 0).when(bad, 1)
    )


@dataclass(frozen=True)
class PolicyColumn:
    """A policy whose values are fields of a struct column of each message; it stands where a Policy does."""

    name: str = "policy"

    def __getattr__(self, field: str) -> Column:
        if field not in NAMES:
            raise AttributeError(field)
        return F.col(f"{self.name}.{field}")


NAMES = tuple(f.name for f in fields(Policy))


def resolve(settings: DataFrame, overrides: dict[str, str] | None = None, default: Policy = Policy()) -> tuple[DataFrame, Column]:
    """(profile, policy) of each profile of ``settings`` (profile, name, value), and the policy of all other messages.

    A value is the first that is a whole number over 0 of: ``overrides``, the profile's setting, the setting without
    a profile, the default's. Names that no policy has are ignored; of several values of one name the largest text counts.
    """
    known, overrides = settings.where(F.col("name").isin(*NAMES)), overrides or {}
    values = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in NAMES]
    top = known.where("profile is null").agg(*values).first()
    general = {n: positive_int(F.lit(top[n]).cast("string"), F.lit(getattr(default, n))) for n in NAMES}

    def policy(own: dict[str, Column]) -> Column:
        given = {n: positive_int(own[n], general[n]) if n in own else general[n] for n in NAMES}
        return F.struct(*[positive_int(F.lit(overrides.get(n)).cast("string"), given[n]).alias(n) for n in NAMES])

    by = known.where("profile is not null").groupBy("profile").agg(*values)
    return by.select("profile", policy({n: F.col(n) for n in NAMES}).alias("policy")), policy({})


def with_policy(mail: DataFrame, settings: DataFrame, overrides: dict[str, str] | None = None, default: Policy = Policy()) -> DataFrame:
    """``mail`` plus policy, a struct, by its column profile; profiles without settings, and null, have the general one."""
    profiles, general = resolve(settings, overrides, default)
    profiles = F.broadcast(profiles) if profiles.limit(MOST_PROFILES + 1).count() <= MOST_PROFILES else profiles
    return mail.drop("policy").join(profiles, "profile", "left").withColumn("policy", F.coalesce("policy", general))
