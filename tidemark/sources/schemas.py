"""Explicit schemas of the logical source tables."""

from __future__ import annotations

EVENTS = """event_id long, idempotency_key string, vid string, user_id long,
created_at timestamp_ntz, event_type string, surface string, matomo_idgoal int,
category string, action string, url string, ua string, country string, metadata string"""

REVENUE = """txn_id long, user_id long, amount_usd decimal(18,2), status string,
transaction_date timestamp_ntz, provider string, billing_plan_id long, currency string,
country string"""

REQUESTS = """event_id long, ts timestamp_ntz, user_id long, file_id long, base_path string,
status int, bytes_sent long, is_stall int, proto string, node string, req_time_ms long,
country string"""

SUBSCRIPTION_STATE = """user_id long, last_event_type string, last_event_at timestamp_ntz,
current_plan_id long"""

# per-user-day extracts kept as delimited files without a header
USER_DAY_EMAIL = "user_id long, day date, mautic_sent int, internal_sent int, opened int, clicked int"
USER_DAY_WEB = """user_id long, day date, pageviews int, file_dl int, archive_dl int, file_views int,
streams int, pricing_views int, goal4 int, promo_sub int, sessions int"""
USER_DAY_TASK = "user_id long, day date, completed int, failed int, storage_warnings int"

FILE_NODE = """struct<size: bigint, relative_path: string, title: string, last_update: string,
is_lost: string, folder_id: bigint>"""
