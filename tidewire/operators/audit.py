"""Register audit, entity resolution and agreement checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewire.operators import labelling


def group_agreement(
    votes: DataFrame, domains: DataFrame, countries: DataFrame,
    min_articles: int = 100, min_confidence: float = 0.7,
) -> DataFrame:
    """Article-weighted agreement of name-based groups with the majority country.

    Only publishers with enough articles and a clear majority are judged.
    """
    sure = votes.filter(
        (F.col("n_articles") >= min_articles) & (F.col("confidence") >= min_confidence)
    )
    named = sure.join(
        F.broadcast(domains.withColumnRenamed("group", "domain_group")), "publisher", "left"
    ).join(
        F.broadcast(countries.withColumnRenamed("group", "country_group")), "country", "left"
    ).withColumn("tld_group", labelling.tld_group("publisher"))
    group = F.coalesce("domain_group", "tld_group", F.lit("other"))
    method = (
        F.when(F.col("domain_group").isNotNull(), "domain")
        .when(F.col("tld_group").isNotNull(), "tld").otherwise("none")
    )
    agrees = group == F.coalesce("country_group", F.lit("other"))
    return named.groupBy(group.alias("source_group"), method.alias("method")).agg(
        F.count("*").alias("n_domains"),
        F.sum("n_articles").alias("n_articles"),
        F.try_divide(F.sum(F.when(agrees, F.col("n_articles")).otherwise(0)),
                     F.sum("n_articles")).alias("agreement"),
    )


def confirm_sites(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """(host, domain) pairs where one is the other, its subdomain or its parent.

    Exploding the dotted suffixes of each side turns the suffix test into two equality
    joins, so no host is compared with every domain.
    """
    from tidewire.functions import columns as c
    sub = hosts.select("host", F.explode(c.parent_domains("host")).alias("key")).join(
        domains.select("domain", F.lower("domain").alias("key")), "key")
    parent = domains.select(
        "domain", F.explode(c.parent_domains(F.lower("domain"))).alias("key")
    ).join(hosts.select("host", F.col("host").alias("key")), "key")
    both = sub.select("host", "domain").unionByName(parent.select("host", "domain"))
    return both.filter(F.col("host") != "").distinct()


# --- register audit ------------------------------------------------------------------

def audit_register(register: DataFrame, reference: DataFrame) -> DataFrame:
    """Every registered publisher against an outside reference.

    ``register`` is (domain, ecosystem), ``reference`` (domain, qid, country, label,
    optional state_owned). An empty country is no country: such a publisher is unverified,
    which is neither a success nor a failure.
    """
    from tidewire import fixed_values as fixed
    pairs = [v for k, c in fixed.LABEL_COUNTRY.items() for v in (F.lit(k), F.lit(c))]
    claimed = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("ecosystem")), "ecosystem")
    joined = register.join(reference, "domain", "left")
    found = F.nullif(F.col("country"), F.lit(""))
    out = joined.withColumns({
        "register_country": claimed, "found_country": found,
        "identity": F.when(F.col("qid").isNotNull(), "website-confirmed").otherwise("unresolved")})
    return out.withColumn(
        "verdict", F.when(F.col("found_country").isNull(), "unverified")
        .when(F.col("found_country") == F.col("register_country"), "match").otherwise("mismatch"))


def precision_by_label(audit: DataFrame) -> DataFrame:
    """Per label and overall (NULL label): outlets, verified, matches, precision over the
    verified ones only, and NULL when none is verified."""
    match, verified = F.col("verdict") == "match", F.col("verdict") != "unverified"
    return audit.rollup("ecosystem").agg(
        F.count("*").alias("outlets"), F.count_if(verified).alias("verified"),
        F.count_if(match).alias("matches"),
        F.count_if(F.col("verdict") == "mismatch").alias("mismatches"),
        F.try_divide(F.count_if(match), F.count_if(verified)).alias("precision"),
        F.grouping("ecosystem").cast("int").alias("is_overall"))


def reason_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("identity").agg(
        F.count("*").alias("outlets"),
        F.count_if(F.col("verdict") == "unverified").alias("unverified"))


def ownership_agreement(audit: DataFrame) -> DataFrame:
    """State or independent against recorded ownership, where ownership is known."""
    ru = audit.filter(F.col("ecosystem").isin("RU_STATE", "RU_INDEP"))
    agrees = (F.col("ecosystem") == "RU_STATE") == F.col("state_owned")
    return ru.agg(
        F.count("*").alias("n"), F.count("state_owned").alias("n_known"),
        F.try_divide(F.count_if(agrees), F.count("state_owned")).alias("agreement"))


# --- resolution over a claims table ------------------------------------------------------

def item_country(claims: DataFrame) -> DataFrame:
    """Country and label of each item from its country claims.

    ``claims`` is (item, property, position, value). A present-day country outranks a
    defunct one, property P17 outranks P495, and listing order breaks ties. Unknown
    countries do not count.
    """
    from tidewire import fixed_values as fixed
    pairs = [v for label, items in fixed.COUNTRY_ITEMS.items() for i in items
             for v in (F.lit(i), F.lit(label))]
    known = claims.filter(F.col("property").isin("P17", "P495")).withColumn(
        "country", F.try_element_at(F.create_map(*pairs), F.col("value"))
    ).filter(F.col("country").isNotNull())
    order = F.struct(F.col("value").isin(fixed.DEFUNCT_COUNTRIES), F.col("property"), F.col("position"))
    return known.groupBy("item").agg(
        F.min_by("value", order).alias("country_item"), F.min_by("country", order).alias("country"))


def item_ownership(claims: DataFrame, labels: DataFrame, first: int | None = None) -> DataFrame:
    """Whether any owner, or any of the ``first`` listed ones, carries a state word in its label.

    Items without a labelled owner give no row: that is unknown, not independent.
    """
    from tidewire import fixed_values as fixed
    owners = claims.filter(F.col("property").isin("P127", "P749"))
    if first is not None:
        owners = labelling.top_in_group(
            owners, ["item"], [F.asc("property"), F.asc("position"), F.asc("value")], first)
    named = owners.join(labels.select(F.col("item").alias("value"), "label"), "value")
    words = F.lower("label").rlike("|".join(fixed.STATE_OWNER_WORDS))
    return named.filter(F.col("label") != "").groupBy("item").agg(
        F.bool_or(words).alias("state_owned"))


def resolve_items(domains: DataFrame, claims: DataFrame) -> DataFrame:
    """The item each domain's website confirms.

    A candidate is confirmed when its official site (P856) is the domain, a subdomain or its
    parent. Among several, one with a country wins, then the lowest item number.
    """
    from tidewire.functions import columns as c
    sites = claims.filter(F.col("property") == "P856").select(
        "item", c.host("value").alias("host")).filter(F.col("host") != "")
    pairs = confirm_sites(sites.select("host").distinct(), domains.select("domain").distinct())
    confirmed = pairs.join(sites.distinct(), "host").join(item_country(claims), "item", "left")
    number = F.regexp_extract("item", r"(\d+)$", 1).cast("bigint")
    order = F.struct(F.col("country").isNull(), number)
    best = confirmed.groupBy("domain").agg(
        F.min_by("item", order).alias("item"), F.min_by("country", order).alias("country"))
    return domains.select("domain").distinct().join(best, "domain", "left")
