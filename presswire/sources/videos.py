"""Video metadata as the tools show it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACKS = "map<string,array<struct<ext:string>>>"
INFO = f"title string, channel string, duration double, description string, tags array<string>, subtitles {TRACKS}, automatic_captions {TRACKS}"
# Kinds of captions that can be read.
READABLE = ["vtt", "json3", "srv1"]


def _english(tracks: Column) -> Column:
    """There is an English track of a readable kind."""
    own = F.try_element_at(F.coalesce(tracks, F.create_map().cast(TRACKS)), F.lit("en"))
    return F.coalesce(F.exists(own, lambda s: s["ext"].isin(READABLE)), F.lit(False))


def metadata(videos: DataFrame, json: str = "json", description_chars: int = 2000, most_tags: int = 20) -> DataFrame:
    """Adds title, channel, duration, description and tags within the output's limits, has_captions of a video's JSON. What is no JSON has none."""
    p = F.from_json(json, INFO)
    return videos.withColumns(
        {
            "title": F.coalesce(p["title"], F.lit("")),
            "channel": F.coalesce(p["channel"], F.lit("")),
            "duration": F.coalesce(p["duration"], F.lit(0.0)),
            "description": F.substring(F.coalesce(p["description"], F.lit("")), 1, description_chars),
            "tags": F.slice(F.coalesce(p["tags"], F.array().cast("array<string>")), 1, most_tags),
            "has_captions": _english(p["subtitles"]) | _english(p["automatic_captions"]),
        }
    )
