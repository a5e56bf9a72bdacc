"""HTML extraction by consensus host paths.

Pass 1 walks each page, scores its containers by the running text directly in them, and names the best one by its generalised
path of tags and classes. Spark counts these votes per host. Pass 2 walks each page again and extracts the containers on the
first of the host's winning paths that it has; a page that has none of them uses the path that it voted for itself.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import saved, short_batches, with_group, without

#: A path wins with one in so many of its host's votes, so a host has no more winning paths than that.
SHARE = 32
#: A table of winners up to this many bytes is broadcast; a larger one is joined by host, hosts spread over slices.
BROADCAST_BYTES = 32 << 20

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hr center fieldset nav header footer aside form hgroup dialog menu".split())
CONTAINER = frozenset("body main article section div td blockquote center details".split())
SKIP = frozenset("nav footer aside form script style noscript iframe button select option textarea template svg canvas object audio video dialog menu head title label input datalist math".split())
#: Start tags that end an open element of the second kind, up to an element of the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: First or last words of class names, ids and roles that mark what isn't the article.
NOISE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar breadcrumb breadcrumbs footer contentinfo complementary search comment comments commentlist reply replies respond disqus social share sharing related recommended recommendations newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices alert popup modal overlay widget widgets pagination pager toolbar masthead hidden".split())
READERS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: Words in a name that make it the page's frame or body in spite of a word of noise.
FRAME = frozenset("content main article post body wrapper container page layout has with without no entry story text result results".split())


def _names(attributes: str) -> tuple[list[str], list[str], bool]:
    """Classes, all names (classes, id, role), and whether the element is hidden."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    classes = found.get("class", "").lower().split()
    hidden = bool(re.search(r"display\s*:\s*none", found.get("style", ""))) or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"(?:^|\s)hidden(?:[\s=/]|$)", attributes))
    return classes, [*classes, *found.get("id", "").lower().split(), *found.get("role", "").lower().split()], hidden


def _noise(names: list[str], words: frozenset[str]) -> bool:
    for name in names:
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if parts and (parts[0] in words or parts[-1] in words) and not FRAME.intersection(parts):
            return True
        if parts and words is NOISE and READERS.intersection((parts[0], parts[-1])):
            return True
    return False


def _step(path: str, step: str) -> str:
    """The name of a path one step longer: its last step, and a digest of all steps, so names stay short on deep pages."""
    return f"{step[:100]}>{hashlib.blake2b(f'{path} {step}'.encode('utf-8', 'replace'), digest_size=12).hexdigest()}"


def walk(page: str) -> tuple[list[str], list[int], list[tuple[str, int, int]]]:
    """Paths of the containers, their parents (-1: none), and the blocks (text, characters outside links less those in
    links, innermost container) that are not in a menu, header, footer, sidebar, notice, advert, form, script, style or
    reader comment. Blocks have their white space made single spaces and are not empty. Memory grows with the page, however deep
    its tags are."""
    paths, parents, blocks = [], [], []
    stack: list[tuple[str, str, int, bool]] = [("", "", -1, False)]  # tag, path, container, skipped
    inside: Counter = Counter()  # open elements of each tag
    buffer: list[str] = []
    linked = skipped = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                blocks.append((text, len(text) - 2 * linked, stack[-1][2]))
            buffer.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal skipped
        if any(x[0] in BLOCK for x in stack[to:]):
            flush()
        for x in stack[to:]:
            skipped -= x[3]
            inside[x[0]] -= 1
        del stack[to:]

    at = 0
    for m in iter_tags(page):
        if not skipped and m.start() > at:
            piece = page[at : m.start()]
            buffer.append(piece)
            if inside["a"]:
                linked += len(piece)
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            buffer.append(" ") if not skipped else None
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1) if inside[tag] else ():
                if stack[i][0] == tag:
                    pop(i)
                    break
                if stack[i][0] in BLOCK and tag not in BLOCK and tag not in SKIP:
                    break  # an inline end tag does not end a block
            continue
        block = tag in BLOCK
        if block and inside["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag in CLOSES:
            ends, limits = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1) if any(inside[x] for x in ends) else ():
                if stack[i][0] in ends:
                    pop(i)
                elif stack[i][0] in limits:
                    break
        if tag in VOID:
            if block:
                flush()
            continue
        if block:
            flush()
        classes, names, hidden = _names(attributes) if attributes.strip() else ([], [], False)
        skip = tag in SKIP or hidden
        if not skip and tag not in ("html", "body", "main"):
            skip = _noise(names, READERS if tag == "article" else NOISE)
            heading = tag == "header" or any(n.split("-")[-1] == "header" for n in names)
            skip = skip or heading and not (inside["article"] or inside["main"])
        path, container = stack[-1][1], stack[-1][2]
        if block:
            path = _step(path, ".".join([tag, *sorted(re.sub(r"\d+", "#", c) for c in classes)]))
            if tag in CONTAINER and not skipped and not skip:
                paths.append(path)
                parents.append(container)
                container = len(paths) - 1
        if attributes.rstrip().endswith("/") and not block and tag not in RAW and tag not in SKIP:
            continue
        stack.append((tag, path, container, skip))
        skipped += skip
        inside[tag] += 1
    if not skipped and at < len(page):
        buffer.append(page[at:].split("<")[0] if re.match(r"[^<]*<[a-zA-Z/!]", page[at:]) else page[at:])
    flush()
    return paths, parents, blocks


def iter_tags(page: str) -> Iterator[re.Match]:
    """Tags and comments in order; what is inside raw-text elements is not looked at."""
    at = 0
    while m := TAG.search(page, at):
        yield m
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if tag in RAW and not (m[1] or m[4]):
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)


def best(paths: list[str], parents: list[int], blocks: list[tuple[str, int, int]]) -> tuple[int, float]:
    """The container with the highest score, and the score; (-1, 0.0) if none is positive. A block counts in full for its own
    container, by half for the next one out, by a quarter after that."""
    score = [0.0] * len(paths)
    for _, weight, c in blocks:
        share = float(weight)
        for _ in range(3):
            if c < 0:
                break
            score[c] += share
            share /= 2
            c = parents[c]
    top = max(range(len(paths)), key=lambda i: (score[i], -i), default=-1)
    return (top, score[top]) if top >= 0 and score[top] > 0 else (-1, 0.0)


def extract(page: str, winners: list[str]) -> str:
    """The blocks of the containers on the first of the winning paths that has any, or else on the path of the page's best container,
    or else all blocks; joined by blank lines."""
    paths, parents, blocks = walk(page)

    def within(path: str) -> list[str]:
        chosen = []
        for p, parent in zip(paths, parents, strict=True):  # parents come before their children
            chosen.append(p == path or parent >= 0 and chosen[parent])
        return [text for text, _, c in blocks if c >= 0 and chosen[c]]

    known = set(paths)
    for path in winners:
        if path in known and (found := within(path)):
            return "\n\n".join(found)
    top, _ = best(paths, parents, blocks)
    return "\n\n".join(within(paths[top]) if top >= 0 else [b[0] for b in blocks])


def votes(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """One row per page: its host (_cq_host) and the path and score of its best container (null and 0 if there is none)."""
    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, page in zip(batch["_cq_host"], batch["_cq_html"], strict=True):
                paths, parents, blocks = walk(page or "")
                top, score = best(paths, parents, blocks)
                out.append((host, paths[top] if top >= 0 else None, score))
            yield pd.DataFrame(out, columns=["_cq_host", "path", "score"]).astype({"score": "float64"})

    return pages.select("_cq_host", F.col(html_col).alias("_cq_html")).mapInPandas(vote, "_cq_host string, path string, score double")


def winners(voted: DataFrame) -> DataFrame:
    """One row per host: its paths with one vote in SHARE or more, most pages first (equal: higher scores, then the path)."""
    paths = saved(voted.groupBy("_cq_host", "path").agg(F.count(F.lit(1)).alias("pages"), F.sum("score").alias("total")))
    hosts = paths.groupBy("_cq_host").agg(F.sum("pages").alias("all"))
    won = paths.join(hosts, "_cq_host").where("path is not null and pages * {n} >= all".format(n=SHARE))
    order = F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("a"), (-F.col("total")).alias("b"), "path")))
    return won.groupBy("_cq_host").agg(F.transform(order, lambda x: x["path"]).alias("_cq_paths"))


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All rows of pages with text (empty if there is none) and n_chars, its code points.

    Null html counts as empty; pages without a host (null or odd urls) vote together. Input columns named like a result are
    replaced; an empty table gives an empty result. Only the winners' table may be broadcast, after a check of its size.
    """
    plain = without(short_batches(pages), ["text", "n_chars"])
    hosted = plain.withColumn("_cq_host", F.lower(F.coalesce(F.regexp_extract(url_col, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))))
    won = saved(winners(votes(hosted, html_col)))
    size = won.agg(F.sum(F.length("_cq_host") + F.coalesce(F.length(F.concat_ws("", "_cq_paths")), F.lit(0)) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = hosted.join(F.broadcast(won), "_cq_host", "left")
    else:
        joined = with_group(hosted, ["_cq_host"], [html_col], [], won, "left")

    @F.pandas_udf("string")
    def main_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, path in batches:
            yield pd.Series([extract(p or "", [] if w is None else list(w)) for p, w in zip(page, path, strict=True)], dtype=object)

    return joined.withColumn("text", main_text(html_col, "_cq_paths")).withColumn("n_chars", F.length("text").cast("long")).select(*plain.columns, "text", "n_chars")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
