"""Per-user file trees landed as JSON text: nodes and account fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
NODE = "struct<size: double, relative_path: string, title: string, last_update: string, is_lost: string, folder_id: string>"
ACCOUNT = """struct<bandwidth_used: double, last_sign_in_stamp: bigint, sign_up_stamp: bigint,
saw_walkthrough: string, org_id: bigint, invited_by: bigint, sso_provider: string,
lost_password_request: bigint, totp_enabled: string, invites_accepted_counter: bigint>"""


def _truthy(col: Column) -> Column:
    """JSON 1/true/'x' against 0/false/null/''."""
    text = F.lower(F.coalesce(col, F.lit("")))
    return (~text.isin("", "0", "false", "null", "none")).cast("int")


def _day(col: Column) -> Column:
    """Epoch day of the first ten characters, NULL if they are no date."""
    return F.unix_date(F.substring(col, 1, 10).try_cast("date"))


def content_status(fetch_status: Column, raw: Column) -> Column:
    """A failed fetch keeps its own status; text that is no JSON object is an 'error'."""
    parsed = F.get_json_object(raw, "$")
    return (
        F.when(fetch_status != "ok", fetch_status)
        .when(parsed.isNull() | ~F.ltrim(parsed).startswith("{"), "error")
        .otherwise("ok")
    )


def parse_nodes(trees: DataFrame) -> DataFrame:
    """One row per file node of (user_id, fetch_status, raw).

    ``fs`` may be an object or a list; entries that are no objects are skipped. Only
    path, size and time leave the document, never names of people or other fields.
    """
    fs = F.get_json_object("raw", "$.fs")
    entries = F.coalesce(
        F.map_values(F.when(F.startswith(fs, F.lit("{")), F.from_json(fs, "map<string, string>"))),
        F.when(F.startswith(fs, F.lit("[")), F.from_json(fs, "array<string>")),
    )
    nodes = (
        trees.filter(content_status(C("fetch_status"), C("raw")) == "ok")
        .select("user_id", F.explode(entries).alias("_text"))
        .filter(C("_text").startswith("{"))
        .select("user_id", F.from_json("_text", NODE).alias("n"))
    )
    path = F.coalesce(F.nullif(C("n.relative_path"), F.lit("")), C("n.title"), F.lit(""))
    return nodes.select(
        "user_id",
        path.alias("relative_path"),
        F.coalesce(C("n.size").cast("bigint"), F.lit(0)).alias("size"),
        _day(C("n.last_update")).alias("last_update_day"),
        _truthy(C("n.is_lost")).alias("is_lost"),
        C("n.folder_id").alias("folder_id"),
    )


def parse_accounts(trees: DataFrame) -> DataFrame:
    """One row per document: status, root size and account fields."""
    user = F.from_json(F.get_json_object("raw", "$.user"), ACCOUNT)
    stamp_day = lambda c: F.floor(c / 86400).cast("int")
    rows = trees.select(
        "user_id",
        content_status(C("fetch_status"), C("raw")).alias("content_status"),
        F.get_json_object("raw", "$.root.size").try_cast("double").cast("bigint").alias("root_size"),
        user.alias("u"),
    )
    return rows.select(
        "user_id", "content_status", F.coalesce("root_size", F.lit(0)).alias("root_size"),
        F.coalesce(C("u.bandwidth_used").cast("bigint"), F.lit(0)).alias("bandwidth_used"),
        F.when(C("u.last_sign_in_stamp") != 0, stamp_day(C("u.last_sign_in_stamp"))).alias("last_signin_day"),
        F.when(C("u.sign_up_stamp") != 0, stamp_day(C("u.sign_up_stamp"))).alias("sign_up_day"),
        _truthy(C("u.saw_walkthrough")).alias("saw_walkthrough"),
        F.coalesce(C("u.org_id") > 0, F.lit(False)).cast("int").alias("is_business"),
        F.coalesce(C("u.invited_by") > 0, F.lit(False)).cast("int").alias("is_referred"),
        _truthy(C("u.sso_provider")).alias("has_sso"),
        F.coalesce(C("u.lost_password_request"), F.lit(0)).alias("lost_pw_requests"),
        _truthy(C("u.totp_enabled")).alias("totp_enabled"),
        F.coalesce(C("u.invites_accepted_counter"), F.lit(0)).alias("invites_accepted"),
    )


def sample_users(ids: DataFrame, n: int) -> DataFrame:
    """Stable sample: the first ``n`` ids in hash order."""
    return ids.select("user_id").distinct().orderBy(F.md5(C("user_id").cast("string")), "user_id").limit(n)


def todo(ids: DataFrame, previous: DataFrame) -> DataFrame:
    """Ids without an 'ok' row in the previous run."""
    done = previous.filter(C("content_status") == "ok").select("user_id")
    return ids.select("user_id").distinct().join(done, "user_id", "left_anti")


def resume(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """'ok' rows of the previous run and the newly processed rest."""
    kept = previous.filter(C("content_status") == "ok")
    rest = fresh.join(kept.select("user_id"), "user_id", "left_anti")
    return kept.unionByName(rest, allowMissingColumns=True)
