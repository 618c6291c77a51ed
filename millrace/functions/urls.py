"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts of the video site and the first path parts behind which an id stands.
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be", "www.youtu.be")
VIDEO_PATHS = ("embed", "shorts", "live", "v")


def _full(url: Column) -> Column:
    u = F.trim(url)
    return F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(_full(url), F.lit("HOST")))


def is_allowed_host(url: Column, hosts: tuple[str, ...] = VIDEO_HOSTS) -> Column:
    scheme = F.lower(F.try_parse_url(_full(url), F.lit("PROTOCOL")))
    return F.coalesce(scheme.isin("http", "https") & url_host(url).isin(*hosts), F.lit(False))


def video_id(url: Column) -> Column:
    """The id in ?v=, behind a short host or behind /embed, /shorts, /live, /v; null where there is none."""
    full = _full(url)
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(full, F.lit("PATH")), F.lit("")), "/"), lambda p: F.trim(p) != "")
    query = F.nullif(F.trim(F.regexp_extract(F.concat(F.lit("&"), F.coalesce(F.try_parse_url(full, F.lit("QUERY")), F.lit(""))), r"[&]v=([^&#]*)", 1)), F.lit(""))
    short = F.when(url_host(url).isin("youtu.be", "www.youtu.be"), F.try_element_at(parts, F.lit(1)))
    path = F.when((F.size(parts) >= 2) & F.try_element_at(parts, F.lit(1)).isin(*VIDEO_PATHS), F.try_element_at(parts, F.lit(2)))
    return F.coalesce(short, query, path)


def watch_url(url: Column, hosts: tuple[str, ...] = VIDEO_HOSTS) -> Column:
    """The one form of a video's address, without tracking and offsets; null for other hosts or without an id."""
    return F.when(is_allowed_host(url, hosts), F.concat(F.lit("https://www.youtube.com/watch?v="), video_id(url)))


def playlist_id(url: Column) -> Column:
    """The list id of a playlist's address, or null."""
    return F.nullif(F.regexp_extract(F.concat(F.lit("&"), F.coalesce(F.try_parse_url(_full(url), F.lit("QUERY")), F.lit(""))), r"&list=([^&#]*)", 1), F.lit(""))
