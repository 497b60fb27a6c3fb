"""Row-level access: tokens of documents and users, the read filter, decisions, department trees."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUBLIC, INTERNAL, NO_ACCESS = "public", "internal", "_NO_ACCESS"
MAX_DEPTH = 20


@dataclass(frozen=True)
class Identity:
    """Who asks: user, own department with its ancestors, roles."""

    user: str = ""
    departments: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    admin: bool = False

    @property
    def anonymous(self) -> bool:
        return not self.user

    def tokens(self) -> list[str]:
        if self.anonymous:
            return [PUBLIC]
        return list(dict.fromkeys([PUBLIC, INTERNAL, f"user::{self.user}", *(f"dept::{d}" for d in self.departments), *(f"role::{r}" for r in self.roles)]))


def acl_tokens(visibility: Column, chain: Column, owner: Column, users: Column | None = None, roles: Column | None = None) -> Column:
    """Tokens of a document: by visibility PUBLIC, INTERNAL, DEPT (its department chain), PRIVATE (owner), GRANT (owner and grants)."""
    own = F.filter(F.array(F.concat(F.lit("user::"), owner)), lambda x: x.isNotNull())
    empty = F.array().cast("array<string>")
    granted = F.concat(own, F.transform(users, lambda u: F.concat(F.lit("user::"), u)) if users is not None else empty, F.transform(roles, lambda r: F.concat(F.lit("role::"), r)) if roles is not None else empty)
    return (
        F.when(visibility == "PUBLIC", F.array(F.lit(PUBLIC))).when(visibility == "INTERNAL", F.array(F.lit(INTERNAL)))
        .when(visibility == "DEPT", F.transform(chain, lambda d: F.concat(F.lit("dept::"), d))).when(visibility == "GRANT", F.array_distinct(granted)).otherwise(own)
    )


def resolve_tokens(tokens: Column, json_tokens: Column, legacy: Column, missing: str = "no_access") -> Column:
    """Tokens of a payload: the list, else its JSON form, else the comma-separated form, else what the policy says."""
    parsed = F.from_json(json_tokens, "array<string>")
    split = F.filter(F.transform(F.split(F.replace(legacy, F.lit("，"), F.lit(",")), ","), lambda x: F.trim(x)), lambda x: x != "")
    some = lambda c: F.when(F.size(c) > 0, c)
    last = {"internal": F.array(F.lit("_INTERNAL")), "no_access": F.array(F.lit(NO_ACCESS)), "error": F.raise_error(F.lit("acl_tokens are missing")).cast("array<string>")}[missing]
    return F.coalesce(some(tokens), some(parsed), some(split), last)


def readable(who: Identity, tokens: Column, visibility: Column, units: Column, owner: Column) -> Column:
    """The read filter: token overlap (by visibility and owner where a row has no tokens), and for DEPT rows one of the user's own units."""
    if who.admin:
        return F.lit(True)
    mine = F.array(*[F.lit(t) for t in who.tokens()])
    depts = F.array(*[F.lit(x) for x in who.departments]).cast("array<string>")
    old = visibility == "PUBLIC"
    if not who.anonymous:
        old = old | (visibility == "INTERNAL") | (owner == who.user)
    by_token = F.when(F.size(F.coalesce(tokens, F.array().cast("array<string>"))) > 0, F.arrays_overlap(tokens, mine)).otherwise(F.coalesce(old, F.lit(False)))
    unit = (F.coalesce(visibility, F.lit("")) != "DEPT") | F.coalesce(F.arrays_overlap(units, depts), F.lit(False))
    return F.coalesce(by_token, F.lit(False)) & unit


def latest(is_latest: Column) -> Column:
    """Rows without the flag count as latest."""
    return F.coalesce(is_latest, F.lit(True))


def ancestors(tree: DataFrame, code: str = "code", parent: str = "parent") -> DataFrame:
    """(code, ancestor, depth), itself at depth 0, by a recursive query of at most MAX_DEPTH levels."""
    spark = tree.sparkSession
    rows = tree.select(F.col(code).alias("code"), F.col(parent).alias("parent"))
    return spark.sql(
        f"""
        with recursive up(code, ancestor, depth) as (
          select code, code, 0 from {{tree}}
          union all
          select up.code, t.parent, up.depth + 1 from up join {{tree}} t on up.ancestor = t.code where t.parent is not null and up.depth < {MAX_DEPTH})
        select code, ancestor, depth from up
        """,
        tree=rows,
    )


def fold_decisions(rows: DataFrame, keys: list[str], effect: str = "effect") -> DataFrame:
    """Any DENY denies, else any ALLOW allows, else ABSTAIN."""
    e = F.col(effect)
    fold = F.when(F.bool_or(e == "DENY"), "DENY").when(F.bool_or(e == "ALLOW"), "ALLOW").otherwise("ABSTAIN")
    return rows.groupBy(*keys).agg(fold.alias("decision"))


def active(rows: DataFrame, now: Column, expires: str = "expires_at", flag: str = "is_active") -> DataFrame:
    return rows.where((F.col(flag) == 1) & (F.col(expires).isNull() | (F.col(expires) > now)))


def decide(docs: DataFrame, decisions: DataFrame, grants: DataFrame, who: Identity) -> DataFrame:
    """Documents (source_name, status, visibility, chain, owner) with ``allowed`` and the reason.

    Explicit decisions first, then visibility; a missing visibility is private; deleted documents are denied.
    """
    mine = grants.where(F.col("grantee_id").isin(who.user, *who.roles) if who.user else F.lit(False)).select(F.col("source_name").alias("g_")).distinct()
    d = docs.join(decisions.select("source_name", "decision"), "source_name", "left").join(mine, docs["source_name"] == F.col("g_"), "left")
    vis = F.coalesce("visibility", F.lit("PRIVATE"))
    own = F.coalesce(F.col("owner") == who.user, F.lit(False)) if who.user else F.lit(False)
    dept = F.coalesce(F.arrays_overlap("chain", F.array(*[F.lit(x) for x in who.departments[:1]]).cast("array<string>")), F.lit(False))
    reason = (
        F.when(F.coalesce("status", F.lit("DELETED")) == "DELETED", "deny:deleted").when(F.lit(who.admin), "allow:admin").when(F.col("decision") == "DENY", "deny:acl")
        .when(F.col("decision") == "ALLOW", "allow:acl").when(vis == "PUBLIC", "allow:public").when((vis == "INTERNAL") & F.lit(not who.anonymous), "allow:internal")
        .when((vis == "DEPT") & dept, "allow:dept").when(own, "allow:owner").when((vis == "GRANT") & F.col("g_").isNotNull(), "allow:grant").otherwise(F.concat(F.lit("deny:"), F.lower(vis)))
    )
    return d.select("source_name", reason.alias("reason")).withColumn("allowed", F.startswith("reason", F.lit("allow")))


def grant(tokens: Column, token: Column) -> Column:
    return F.array_union(F.coalesce(tokens, F.array().cast("array<string>")), F.array(token))


def revoke(tokens: Column, token: Column) -> Column:
    """Without the token; the last token gone leaves no access."""
    left = F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t != token)
    return F.when(F.size(left) == 0, F.array(F.lit(NO_ACCESS))).otherwise(left)
