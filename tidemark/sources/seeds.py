"""Small literal lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: plan id, storage in GB, plan name, confidence ----------------
PLAN_STORAGE = (
    (0, 2, "Free", "base"),
    (1, 30, "Basic", "confident"),
    (2, 30, "Basic-annual", "confident"),
    (3, 100, "Pro", "confident"),
    (4, 100, "Pro-annual", "confident"),
    (5, 1000, "Master", "confident"),
    (6, 1000, "Master-annual", "confident"),
)

# --- fixed values: file extensions per content category -------------------------
CATEGORY_EXTENSIONS = {
    "video": "mkv mp4 avi vob m4v wmv mov flv mpg mpeg ts m2ts webm divx",
    "audio": "mp3 m4a m4b flac aac wav ogg opus wma",
    "ebook": "epub pdf mobi azw azw3 djvu fb2 cbz cbr",
    "software": "exe dmg iso pkg apk msi bin deb appimage",
    "archive": "zip rar 7z tar gz bz2",
    "image": "jpg jpeg png gif bmp webp heic",
    "submeta": "srt sub idx nfo ifo bup sfv vtt",
}

# --- fixed values: persona per primary content category -------------------------
PERSONAS = {
    "video": "video_streamer",
    "audio": "music_audio",
    "ebook": "reader",
    "software": "software_downloader",
    "archive": "archive_hoarder",
    "image": "image_store",
}
# --------------------------------------------------------------------------------

CATEGORIES = (*CATEGORY_EXTENSIONS, "other")


def plan_storage(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(PLAN_STORAGE),
        "billing_plan_id long, storage_gb int, plan_name string, confidence string",
    )


def content_category(extension: Column) -> Column:
    """Category of a file extension; unknown ones are 'other'."""
    expr = None
    for category, text in CATEGORY_EXTENSIONS.items():
        hit = extension.isin(text.split())
        expr = F.when(hit, category) if expr is None else expr.when(hit, category)
    return expr.otherwise("other")
