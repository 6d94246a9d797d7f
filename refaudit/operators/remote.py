"""The audit against a remote service, for where no table of works is at hand: lookups, candidates and their failures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lookup import Config, doi_url, fetch_json, search_url
from ..sources.works import CANDIDATE, normalize_works, usable
from .audit import decided
from .match import explained, ranked, scored, with_keys

BAD_JSON = "Remote answer is not JSON"


def answers(refs: DataFrame, key: list[str], get: Callable[[str], tuple[int, str, float | None]], config: Config = Config(), **fetch) -> DataFrame:
    """key, error, error_status and `works`, the candidates as JSON texts, for refs (key, reference, ref_doi): one lookup a
    reference, by DOI where there is one, else a search. A body that isn't JSON is an error without a status."""
    url = F.when(F.col("ref_doi").isNotNull(), doi_url(F.col("ref_doi"), config)).otherwise(search_url(F.col("reference"), config))
    got = fetch_json(refs.select(*key, F.col("ref_doi").isNotNull().alias("_one"), url.alias("url")), get, config, **fetch)
    got = got.withColumn("_v", F.try_parse_json("body"))
    one = F.array(F.try_variant_get("_v", "$.message", "variant"))
    many = F.slice(F.coalesce(F.try_variant_get("_v", "$.message.items", "array<variant>"), F.array().cast("array<variant>")), 1, config.rows)
    works = F.transform(F.when(F.col("_one"), one).otherwise(many), lambda x: F.to_json(x))
    broken = F.col("error").isNull() & F.col("_v").isNull()
    return got.select(*key, F.when(broken, BAD_JSON).otherwise(F.col("error")).alias("error"), F.when(~broken, F.col("status")).alias("error_status"), F.when(F.col("error").isNull() & ~broken, works).alias("works"))


def audit_remote(refs: DataFrame, key: list[str], get: Callable[[str], tuple[int, str, float | None]], config: Config = Config(), **fetch) -> DataFrame:
    """One row of audit.RESULT (after key) per row of refs (key, reference), as audit.audit, with the failures of lookups in
    place of what a table can't tell. Answers are fetched once: write the result before it is read more than once."""
    keyed = with_keys(refs.select(*key, "reference"))
    got = answers(keyed.select(*key, "reference", "ref_doi"), key, get, config, **fetch)
    items = got.select(*key, "error", "error_status", F.posexplode_outer("works").alias("_i", "json"))
    found = usable(normalize_works(items)).select(*key, "_i", F.struct(*CANDIDATE).alias("cand"))
    # A reference whose search found nothing usable, or failed, keeps a row without a candidate.
    pairs = keyed.join(got.select(*key, "error", "error_status"), key).join(found, key, "left").withColumn("ord", F.coalesce("_i", F.lit(0)) + 1).drop("_i")
    return decided(explained(ranked(scored(pairs, explain=False), key).where("rank = 1")), key)
