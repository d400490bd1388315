"""Rulesets and the choice of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import patterns as P

# The built-in rulesets; an empty one means every pattern.
RULESETS = {
    "programming": ["api_key", "aws_key", "jwt", "uuid", "ipv4", "ipv6", "mac"],
    "repository": ["vendor_secret", "private_key", "aws_key", "jwt", "api_key", "secret_assignment", "url_credentials", "email", "home_dir", "iban", "ipv4"],
    "identity": ["person", "email", "phone_us", "phone_intl", "ssn", "ssn_nodash", "passport_us", "drivers_license", "date"],
    "contact": ["email", "phone_us", "phone_intl", "street_address", "city", "state", "country", "zip_code", "social_handle", "twitter_handle", "social_url"],
    "financial": ["credit_card", "credit_card_nodash", "iban"],
    "gdpr": ["person", "email", "phone_us", "phone_intl", "street_address", "city", "country", "ipv4", "ipv6", "date", "iban", "uk_nino", "fr_nir", "it_cf", "es_dni", "eu_id", "geocoord"],
    "hipaa": ["person", "email", "phone_us", "phone_intl", "street_address", "city", "state", "zip_code", "ssn", "ssn_nodash", "date", "ipv4", "ipv6", "mac"],
    "all": [],
    "minimal": ["email", "phone_us", "ssn", "credit_card", "ipv4", "uuid"],
}


def pattern_table(spark: SparkSession) -> DataFrame:
    """The 36 patterns as a table."""
    rows = [(i, p.name, p.confidence, P.CONFIDENCE_RANK[p.confidence], p.category, p.template) for i, p in enumerate(P.ALL)]
    return spark.createDataFrame(rows, "ordinal int, name string, confidence string, rank int, category string, template string")


def selected(patterns: DataFrame, least: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Confidence at least ``least``, among ``include`` unless that is empty, not among ``exclude``."""
    return patterns.filter((F.col("rank") >= P.CONFIDENCE_RANK[least]) & (F.lit(not include) | F.col("name").isin(include)) & ~F.col("name").isin(exclude))


def ruleset_table(spark: SparkSession) -> DataFrame:
    """(ruleset, pattern)."""
    return spark.createDataFrame([(r, n) for r, ns in RULESETS.items() for n in ns], "ruleset string, pattern string")


def resolve(cli: list[str] | None, ruleset: str | None, config: list[str] | None) -> list[str]:
    """The names in force: those of the command line, else of the ruleset, else of the configuration, else all."""
    if cli:
        return cli
    if ruleset is not None:
        if ruleset not in RULESETS:
            raise ValueError(f"unknown ruleset: {ruleset}")
        return RULESETS[ruleset] or [p.name for p in P.ALL]
    return config or [p.name for p in P.ALL]
