"""URL keys. Built from regular expressions: parse_url raises on inputs that still must give a host."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"

# Words left out of a slug.
SLUG_STOP = ["the", "a", "an", "and", "or", "of", "to", "in", "for"]


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, NETLOC, 1)


def path(url: Column) -> Column:
    """The path without the last segment's ;params."""
    return F.regexp_replace(F.regexp_extract(url, PATH, 1), r";[^/]*$", "")


def normalize(url: Column) -> Column:
    """scheme://host/path in lower case but for the path; no query, fragment or trailing slashes; user and port stay."""
    return F.concat(F.lower(F.regexp_extract(url, SCHEME, 1)), F.lit("://"), F.lower(netloc(url)), F.regexp_replace(path(url), r"/+$", ""))


def normalize_or_empty(url: Column) -> Column:
    """As normalize, but '' for null and ''."""
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(normalize(url))


def domain(url: Column) -> Column:
    """The host without every 'www.' in it; case and port stay."""
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def dataset_key(name: Column) -> Column:
    """How rated domains are keyed."""
    return F.replace(F.trim(F.lower(name)), F.lit("www."), F.lit(""))


def classifier_domain(text: Column) -> Column:
    """A URL's host (anything that starts with http counts as a URL), else the text as a dataset key."""
    return F.when(text.startswith("http"), domain(text)).otherwise(F.trim(F.lower(F.replace(text, F.lit("www."), F.lit("")))))


def snippet_domain(url: Column) -> Column:
    """The third part of the normalised URL; www. stays."""
    return F.lower(F.split_part(normalize(url), F.lit("/"), F.lit(3)))


def slug_keywords(url: Column) -> Column:
    """Up to six words of the last two path segments."""
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    last = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))
    words = F.split(F.lower(F.array_join(last, "-")), "[^a-zA-Z0-9]+")
    return F.slice(F.filter(words, lambda w: (w != "") & ~w.isin(SLUG_STOP)), 1, 6)


def with_v1(url: Column) -> Column:
    """A local server's base URL: no trailing slashes, ending in /v1 once."""
    bare = F.regexp_replace(F.trim(url), r"/+$", "")
    return F.when(bare.endswith("/v1"), bare).otherwise(F.concat(bare, F.lit("/v1")))


# Hosts that a local bridge may have, and that it may not.
LOCAL_HOSTS = ["localhost", "127.0.0.1", "::1", "host.docker.internal"]
BLOCKED_HOSTS = ["0.0.0.0", "::"]


def host(url: Column) -> Column:
    """The host name alone, lower case; null if there is none."""
    place = F.regexp_replace(netloc(url), r"^.*@", "")
    bracket = F.regexp_extract(place, r"^\[([^\]]*)\]", 1)
    return F.lower(F.nullif(F.when(place.startswith("["), bracket).otherwise(F.regexp_replace(place, r":.*$", "")), F.lit("")))


def port_text(url: Column) -> Column:
    place = F.regexp_replace(netloc(url), r"^.*@", "")
    return F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)


def bridge_errors(url: Column, require_local: bool = True, allow_public: bool = False) -> Column:
    """All that speaks against a bridge URL, in the order in which it is checked; [] if it is fine."""
    name, port = host(url), port_text(url)
    absent = F.coalesce(F.trim(url), F.lit("")) == ""
    shaped = ~absent & ~url.contains("<") & ~url.contains(">")
    web = F.lower(F.regexp_extract(url, SCHEME, 1)).isin("http", "https") & name.isNotNull()
    bad_port = (port != "") & (~port.rlike(r"^[0-9]+$") | (F.coalesce(port.try_cast("int"), F.lit(99999)) > 65535))
    local = name.isin(LOCAL_HOSTS)
    checks = [
        (absent, "missing"),
        (~absent & ~shaped, "placeholder"),
        (shaped & ~F.coalesce(web, F.lit(False)), "not_http"),
        (shaped & web & bad_port, "bad_port"),
        (shaped & web & name.isin(BLOCKED_HOSTS), "blocked_host"),
    ]
    if require_local and not allow_public:
        checks.append((shaped & web & ~local, "not_local"))
    if not (allow_public and not require_local):
        checks.append((shaped & web & ~local, "public"))
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in checks]), lambda x: x.isNotNull())


# Hosts that mean the machine itself.
LOOPBACK = ["localhost", "127.0.0.1", "0.0.0.0", "::1"]


def container_url(url: Column, container_host: str = "host.docker.internal") -> Column:
    """As seen from inside a container: the machine's own hosts become the container's name for it, port, path and scheme stay; others stay whole."""
    port = F.when(port_text(url) != "", F.concat(F.lit(":"), port_text(url))).otherwise("")
    moved = F.concat(F.regexp_extract(url, r"^([^/]*//)", 1), F.lit(container_host), port, F.regexp_replace(url, r"^[^/]*//[^/?#]*", ""))
    return F.when(host(url).isin(LOOPBACK), moved).otherwise(url)
