"""Protection of personal data: lookup hash, ciphertext, pseudonym, anonymised view, k-anonymity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions import expressions as E

# Columns that identify a person directly.
DIRECT_IDENTIFIERS = ["email_hash", "email_cifrado", "alias", "anio_nacimiento", "id", "email"]
MIN_SALT_LENGTH = 32


def protect_users(users: DataFrame, hash_key: str, passphrase: str, salt: str) -> DataFrame:
    """Replace the clear e-mail by a keyed hash for lookups and a ciphertext; add the pseudonym."""
    check_salt(salt)
    return (users.withColumn("email_hash", E.hmac_sha256(F.col("email"), hash_key))
            .withColumn("email_cifrado", E.encrypt_text(F.col("email"), passphrase))
            .withColumn("seudonimo", E.pseudonym(F.col("id"), salt)).drop("email"))


def fill_pseudonyms(users: DataFrame, salt: str) -> DataFrame:
    """Compute the pseudonym only where it is missing; existing ones never change."""
    check_salt(salt)
    return users.withColumn("seudonimo", F.coalesce("seudonimo", E.pseudonym(F.col("id"), salt)))


def check_salt(salt: str | None) -> None:
    if salt is None or len(salt) < MIN_SALT_LENGTH:
        raise ValueError("the pseudonym salt is missing or too short")


def check_no_direct_identifiers(df: DataFrame) -> DataFrame:
    exposed = [c for c in df.columns if c in DIRECT_IDENTIFIERS]
    if exposed:
        raise ValueError(f"direct identifiers exposed: {exposed}")
    return df


def users_with_plan(users: DataFrame, subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Users with the plan of their active subscription (state only, no dates) or ``sin_plan``."""
    p = plans.select(F.col("id").alias("plan_id"), F.col("codigo").alias("plan"))
    active = subscriptions.filter(F.col("estado") == "activa").join(p, "plan_id", "left").select(
        F.col("usuario_id").alias("id"), "plan")
    return users.join(active, "id", "left").withColumn("plan", F.coalesce("plan", F.lit("sin_plan")))


def anonymised_users(users: DataFrame, subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Pseudonym, country, age band, plan, consent, active, sign-up month; the stored pseudonym is read."""
    out = users_with_plan(users, subscriptions, plans).select(
        "seudonimo", "pais", E.age_band(F.col("anio_nacimiento")).alias("tramo_etario"), "plan",
        "consentimiento_personalizacion", "activo", F.trunc(F.col("fecha_alta").cast("date"), "month").alias("mes_alta"))
    return check_no_direct_identifiers(out)


def k_anonymous_counts(anonymised: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Counts by quasi-identifiers, groups below ``k`` withheld: the aggregate may not single anyone out."""
    return anonymised.groupBy(*keys).agg(F.count(F.lit(1)).alias("personas")).filter(F.col("personas") >= k)


def sensitive_access(resource: str, reason: str, rows: DataFrame, user_db: str, user_app: int | None, at) -> DataFrame:
    """Log row for a read of protected data: what, why and how many rows."""
    return rows.agg(F.count(F.lit(1)).alias("filas_afectadas")).select(
        E.literal_ts(at).alias("ocurrido_en"), F.lit(user_db).alias("usuario_bd"),
        F.lit(user_app).cast("long").alias("usuario_app"), F.lit(resource).alias("recurso"), F.lit(reason).alias("motivo"),
        "filas_afectadas")
