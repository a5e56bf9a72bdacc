"""URL classes, ids in URLs, building and resolving URLs. The site is a parameter throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import col

# The character classes of ids in links (they do admit comma and space).
NAME = r"[0-9, a-z, A-Z, _, \-, \.]+"
LIST_NAME = r"[0-9,a-z,A-Z,\-,_,\.]+"


def patterns(site: str) -> dict[str, str]:
    """P11. One anchored pattern for each class of link of a host."""
    base = rf"^http://\Q{site}\E/"
    return {
        "people": f"{base}people/({NAME})/$",
        "group": f"{base}group/({NAME})/$",
        "topic": f"{base}group/topic/([0-9]+)/$",
        "discussion": rf"{base}group/({LIST_NAME})/discussion\?start=([0-9]+)$",
        "comment": rf"{base}group/topic/([0-9]+)/\?start=([0-9]+)$",
    }


def url_class(u: Column | str, site: str) -> Column:
    """P11. The first class that a URL belongs to, or null."""
    return F.coalesce(*(F.when(col(u).rlike(p), F.lit(name)) for name, p in patterns(site).items()))


def url_id(u: Column | str, kind: str, site: str) -> Column:
    """F11. The id in a URL of a class, null for other URLs."""
    return F.nullif(F.regexp_extract(col(u), patterns(site)[kind], 1), F.lit(""))


def url_start(u: Column | str, kind: str, site: str) -> Column:
    """F11. The start row in a discussion or comment URL."""
    return F.regexp_extract(col(u), patterns(site)[kind], 2).try_cast("bigint")


def page_number(start: Column, size: int = 100) -> Column:
    """W5. The page of a start row, from 1."""
    return F.floor(start / size) + 1


def off_page(start: Column, size: int = 100) -> Column:
    """W5. Whether a start row is not a page's first."""
    return start % size != 0


def scheme(u: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(u), r"^([a-zA-Z][\w+.-]*):", 1))


def is_web(u: Column | str) -> Column:
    """P12. http or https."""
    return scheme(u).isin("http", "https")


def host(u: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(u), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(u: Column | str) -> Column:
    return F.regexp_extract(col(u), r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)


def topic_url(topic_id: Column | str, site: str, start: Column | None = None) -> Column:
    """F13."""
    base = F.concat(F.lit(f"http://{site}/group/topic/"), col(topic_id).cast("string"), F.lit("/"))
    return base if start is None else F.concat(base, F.lit("?start="), start.cast("string"))


def discussion_url(group_id: Column | str, site: str, start: Column) -> Column:
    return F.concat(F.lit(f"http://{site}/group/"), col(group_id), F.lit("/discussion?start="), start.cast("string"))


def _parts(u: Column) -> dict[str, Column]:
    """Scheme (with its colon), authority (with its slashes), path, query and fragment (with their marks) of a reference."""
    pattern = r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
    return {name: F.regexp_extract(u, pattern, i) for i, name in enumerate(("scheme", "authority", "path", "query", "fragment"), 1)}


def resolve(base: Column | str, href: Column | str) -> Column:
    """F13. An href against the URL of its page: absolute, //host, /path, ?query, #fragment, or relative to the page's folder.

    Dot segments are taken out of a joined path, however many; those that lead above the root are dropped. An empty href is the page,
    and an href whose scheme is the page's is relative like one without. An href of another scheme, and one with a host of its own,
    stay as they are. Null if either is null.
    """
    b, h = col(base), F.regexp_replace(F.regexp_replace(col(href), r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    at, to = _parts(b), _parts(h)
    # The folder's segments, then the href's; empty ones within are dropped.
    folder = F.when(F.substring(to["path"], 1, 1) == "/", F.lit("")).otherwise(F.regexp_replace(at["path"], r"[^/]+$", ""))
    raw = F.split(F.when(folder == "", to["path"]).otherwise(F.concat(folder, to["path"])), "/", -1)
    inner = F.filter(raw, lambda x, i: (i == 0) | (i == F.size(raw) - 1) | (x != ""))
    kept = F.aggregate(
        inner, F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    ended = F.when(F.element_at(inner, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.coalesce(F.nullif(F.array_join(ended, "/"), F.lit("")), F.lit("/"))
    rooted = F.when((at["authority"] != "") & (F.substring(joined, 1, 1) != "/"), F.concat(F.lit("/"), joined)).otherwise(joined)
    shown = lambda x: F.when(F.length(x) > 1, x).otherwise("")
    origin = F.concat(F.lower(at["scheme"]), at["authority"])
    tail = F.concat(shown(to["query"]), shown(to["fragment"]))
    return (
        F.when(h == "", b)
        .when(b == "", h)
        .when((to["scheme"] != "") & (F.lower(to["scheme"]) != F.lower(at["scheme"])), h)
        .when(F.length(to["authority"]) > 2, F.concat(F.lower(at["scheme"]), to["authority"], F.when((to["path"] != "") & (F.substring(to["path"], 1, 1) != "/"), "/").otherwise(""), to["path"], tail))
        .when(to["path"] == "", F.concat(origin, at["path"], F.when(F.length(to["query"]) > 1, to["query"]).otherwise(shown(at["query"])), shown(to["fragment"])))
        .otherwise(F.concat(origin, rooted, tail))
    )


def start_url(u: Column | str) -> Column:
    """F15. Put http:// before a start URL that has no scheme."""
    return F.when(col(u).startswith("http"), col(u)).otherwise(F.concat(F.lit("http://"), col(u)))


def positive(n: int) -> int:
    """F15. A depth or count given by the user."""
    if int(n) <= 0:
        raise ValueError(f"{n} is not a positive number")
    return int(n)
