"""Scores as column expressions; every score that looks at time takes the moment it is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of the ranking function and of rank fusion, the priors of a status, and what truth and calibration weigh.
K1, B = 1.2, 0.75
RRF_K = 60
STATUS_PRIOR = {"verified": 0.92, "active": 0.75, "draft": 0.55, "deferred": 0.50, "superseded": 0.20, "deprecated": 0.15, "rejected": 0.05}
UNKNOWN_PRIOR = 0.60
LEAST_TRUTH, MOST_TRUTH = 0.01, 0.99
MOST_BONUS, BONUS_SCALE = 0.10, 30.0  # for use
AGAINST, MOST_AGAINST = 0.18, 0.9  # for each contradiction, and of the prior in all
VOTES, IGNORED = 3, 0.3  # votes below which feedback says nothing, and what an ignored one counts
LEAST_WEIGHT, MOST_WEIGHT = 0.5, 1.5


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25(weighted_tf: Column, length: Column, mean_length: Column, rarity: Column, k1: float = K1, b: float = B) -> Column:
    """One term's share of a record's score."""
    return rarity * weighted_tf * (k1 + 1) / (weighted_tf + k1 * (1 - b + b * length / mean_length))


def age_days(moment: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), moment.cast("date"))


def date_score(moment: Column, as_of: str) -> Column:
    """1 for today, falling to 0.1 over a year; 0.5 without a date."""
    days = age_days(moment, as_of)
    return F.when(moment.isNull(), 0.5).when(days <= 0, 1.0).otherwise(F.greatest(F.lit(0.1), 1.0 - days / 365.0))


def half_life(moment: Column, as_of: str, days: float = 90.0) -> Column:
    """Half for each so many days of age, never quite 0; 0.5 without a date."""
    age = age_days(moment, as_of)
    return F.when(moment.isNull(), 0.5).when(age <= 0, 1.0).otherwise(F.greatest(F.pow(F.lit(0.5), age / days), F.lit(1e-6)))


def truth(status: Column, moment: Column, accesses: Column, against: Column, as_of: str, days: float = 180.0) -> Column:
    """How far to trust a record: prior of its status, decayed by age, less contradictions, more for use."""
    prior = F.lit(UNKNOWN_PRIOR)
    for name, value in reversed(STATUS_PRIOR.items()):
        prior = F.when(F.lower(status) == name, value).otherwise(prior)
    aged = F.when(moment.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), F.greatest(age_days(moment, as_of), F.lit(0)) / days))
    bonus = F.when(accesses > 0, F.least(F.lit(MOST_BONUS), F.log1p(accesses) / BONUS_SCALE)).otherwise(0.0)
    mass = F.least(F.coalesce(against, F.lit(0.0)) * AGAINST, prior * MOST_AGAINST)
    return F.round(F.greatest(F.lit(LEAST_TRUTH), F.least(F.lit(MOST_TRUTH), prior * aged - mass + bonus)), 4)


def calibration(accepted: Column, rejected: Column, ignored: Column) -> Column:
    """Weight of a record by its feedback: 1 below three votes, else 0.5 plus the smoothed share accepted, in [0.5, 1.5]."""
    against = rejected + ignored * IGNORED
    weight = LEAST_WEIGHT + (accepted + 1.0) / (accepted + against + 2.0)
    return F.when(accepted + rejected + ignored < VOTES, 1.0).otherwise(F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), weight)))


def importance(accesses: Column, days: Column, base: float = 1.0, decay: float = 0.05) -> Column:
    """Importance by accesses and days since the last one, within 0.8 and 1.5."""
    raw = F.lit(base) * (0.5 + 0.3 * F.log(1.0 + accesses) + 0.2 * F.exp(-decay * days))
    return F.least(F.greatest(raw, F.lit(0.8)), F.lit(1.5))


def fixed_hex(fixed: Column) -> Column:
    """Eight hexadecimal digits of a 16.16 fixed-point number, negative ones as two's complement."""
    return F.lpad(F.lower(F.hex(F.when(fixed < 0, fixed + 4294967296).otherwise(fixed))), 8, "0")


def from_fixed(fixed: Column) -> Column:
    return fixed / 65536.0


def tier_boost(tier: Column) -> Column:
    """What a score counts for in each of four tiers."""
    return F.when(tier == 0, 0.7).when(tier == 1, 1.0).when(tier == 2, 1.5).otherwise(2.0)


def predicted_variance(variance: Column, hours: Column, each: float = 0.01) -> Column:
    """A belief's variance after some hours; 1 at most."""
    return F.least(variance + each * hours, F.lit(1.0))


def forgetting_step(status: Column, price: Column, age: Column) -> Column:
    """forget, archive, mark or keep: the first whose conditions hold."""
    out = F.when((status == "F") & (age > 2000), "forget").when((status == "P") & (age > 365), "archive")
    return out.when((price < 50000) & (age > 180), "mark").otherwise("keep")


def budget(tokens: int, answer: float = 0.15, overhead: float = 0.10) -> int:
    """Tokens that evidence may take once the answer's and the overhead's share are set aside."""
    return int(tokens * (1 - answer - overhead))


def date_proximity(asked: Column, own: Column, sigma: float = 30.0) -> Column:
    """0.5 to 1.5 by the days between two dates; 1 where none is asked for, 0.8 where a record has none."""
    apart = F.datediff(own, asked).cast("double")
    return F.when(asked.isNull(), 1.0).when(own.isNull(), 0.8).otherwise(0.5 + F.exp(-apart * apart / (2 * sigma * sigma)))
