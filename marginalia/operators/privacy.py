"""Differential privacy, anonymisation, consent and retention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.catalog import latest

#: Days of retention, until anonymisation and until deletion.
POLICIES = {"identifier": (365, 180, 730), "behavioral": (90, 30, 180), "preferences": (365, 365, 730)}
DEFAULT_POLICY = (365, 180, 730)
#: Rights that every report lists.
RIGHTS = (
    "Right to access your personal data", "Right to rectification of inaccurate data", "Right to erasure ('right to be forgotten')",
    "Right to restrict processing", "Right to data portability", "Right to object to processing", "Right not to be subject to automated decision-making",
)


def laplace(value: Column, sensitivity: float, epsilon: float | None, seed: int) -> Column:
    """Laplace noise of scale sensitivity / epsilon by the inverse of its distribution; none without epsilon."""
    if epsilon is None:
        return value.cast("double")
    u = F.rand(seed) - 0.5
    return value - sensitivity / epsilon * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))


def gaussian(value: Column, sensitivity: float, epsilon: float, delta: float, seed: int) -> Column:
    return value + F.randn(seed) * (sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon)


def randomized_response(value: Column, truth: float, seed: int) -> Column:
    return F.when(F.rand(seed) < truth, value).otherwise(F.rand(seed + 1) < 0.5)


def private_count(df: DataFrame, epsilon: float | None, seed: int = 0) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(F.greatest(F.lit(0), F.bround(laplace(F.col("n"), 1.0, epsilon, seed), 0)).cast("long").alias("n"))


def private_mean(df: DataFrame, column: str, low: float, high: float, epsilon: float | None, seed: int = 0) -> DataFrame:
    """Mean of the values held to [low, high], with noise for a sensitivity of (high - low) / n."""
    v = F.greatest(F.lit(low), F.least(F.lit(high), F.col(column)))
    a = df.agg(F.avg(v).alias("mean"), F.count(column).alias("n"))
    if epsilon is None:
        return a.select(F.coalesce("mean", F.lit(0.0)).alias("mean"))
    u = F.rand(seed) - 0.5
    noise = (high - low) / F.greatest(F.col("n"), F.lit(1)) / epsilon * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))
    return a.select((F.coalesce("mean", F.lit(0.0)) - noise).alias("mean"))


def private_histogram(df: DataFrame, column: str, epsilon: float | None, seed: int = 0) -> DataFrame:
    """Noisy counts of the keys that there are."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.select(column, F.greatest(F.lit(0), F.bround(laplace(F.col("n"), 1.0, epsilon, seed), 0)).cast("long").alias("n"))


def pseudonym(value: Column, salt: str = "") -> Column:
    return F.substring(F.sha2(F.concat(value, F.lit(salt)), 256), 1, 16)


def anonymous_ip(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return F.when(F.size(parts) == 4, F.concat(F.array_join(F.slice(parts, 1, 3), "."), F.lit(".0"))).otherwise(pseudonym(ip))


def masked_email(email: Column) -> Column:
    local = F.regexp_replace(email, "@[^@]*$", "")
    domain = F.substring_index(email, "@", -1)
    stars = lambda n: F.repeat(F.lit("*"), n.cast("int"))
    name = F.when(F.length(local) <= 2, stars(F.length(local))).otherwise(F.concat(F.substring(local, 1, 1), stars(F.length(local) - 2), F.right(local, F.lit(1))))
    return F.when(email.contains("@"), F.concat(name, F.lit("@"), domain)).otherwise("***")


def consent_log(requests: DataFrame) -> DataFrame:
    """Granted requests last a year; addresses are made anonymous and agents cut to 100 characters."""
    expiry = F.when(F.col("granted"), F.col("ts") + F.make_dt_interval(F.lit(365)))
    return requests.withColumns({"status": F.when(F.col("granted"), "granted").otherwise("denied"), "expires_at": expiry, "ip": anonymous_ip(F.col("ip")), "agent": F.substring("agent", 1, 100)})


def withdraw(log: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """The log with later withdrawals (user_id, consent_type, ts) appended."""
    return log.unionByName(withdrawals.withColumn("status", F.lit("withdrawn")), allowMissingColumns=True)


def current_consents(log: DataFrame, *tie: str) -> DataFrame:
    return latest(log, ["user_id", "consent_type"], F.desc("ts"), *(F.desc(t) for t in tie))


def active(status: Column, expires_at: Column, as_of: Column) -> Column:
    return F.coalesce((status == "granted") & (expires_at.isNull() | (expires_at >= as_of)), F.lit(False))


def privacy_report(consents: DataFrame, as_of: Column) -> DataFrame:
    """Categories, activities and recipients that a user's active consents allow, and the user's rights."""
    has = lambda t: F.coalesce(F.bool_or((F.col("consent_type") == t) & active(F.col("status"), F.col("expires_at"), as_of)), F.lit(False))
    u = consents.groupBy("user_id").agg(has("analytics").alias("analytics"), has("personalization").alias("personalization"), has("third_party").alias("third_party"), F.count("*").alias("n_consents"))
    lst = lambda *items: F.array_join(F.array_compact(F.array(*items)), "; ")
    return u.select(
        "user_id", "n_consents", lst(F.lit("identifier"), F.lit("preferences"), F.when(F.col("analytics"), "behavioral")).alias("categories"),
        lst(F.lit("accounts"), F.lit("documents"), F.lit("knowledge graph"), F.when(F.col("personalization"), "recommendations"), F.when(F.col("analytics"), "usage analytics")).alias("activities"),
        lst(F.when(F.col("third_party"), "storage providers"), F.when(F.col("third_party"), "model providers")).alias("recipients"), F.lit(len(RIGHTS)).alias("n_rights"),
    )


def retention_action(category: Column, age_days: Column) -> Column:
    """keep, anonymize or delete, by the age of data of a category."""
    limit = lambda i: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in POLICIES.items() for x in (k, v[i]))), category), F.lit(DEFAULT_POLICY[i]))
    return F.when(age_days >= limit(2), "delete").when(age_days >= limit(1), "anonymize").otherwise("keep")


def deletion_requests(users: DataFrame, as_of: Column) -> DataFrame:
    return users.select("user_id", F.concat(F.lit("del_"), pseudonym(F.col("user_id").cast("string"))).alias("request_id"), F.lit("pending").alias("status"), (as_of + F.make_dt_interval(F.lit(30))).alias("due_at"))


def erased(users: DataFrame, *stores: tuple[DataFrame, str], user: str = "user_id") -> list[DataFrame]:
    """Each store (table, its user column) without the rows of the users."""
    gone = users.select(user).distinct()
    return [df.join(gone.withColumnRenamed(user, key), key, "left_anti") for df, key in stores]
