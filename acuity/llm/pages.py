"""Main text of web pages: page marks first, then repeated token runs of the host.

A page is read into blocks of text. Scripts, styles, forms and elements whose
tag, role, class or id names a menu, header, footer, sidebar, notice, advert or
comment are *boilerplate*. If the page marks its article (``article``, ``main``,
``role=main``), the other blocks inside it are *marked*, but for those in
elements with such a word in a compound class or id (``entry-header``): these
are *open*. So are all other blocks of a page without a mark. The host decides
on both. For open blocks any repeat counts:

1. The tokens of open and boilerplate blocks of the pages of one host are
   joined to one stream and indexed by a suffix array. Suffixes that share
   their first ``RUN`` tokens stand together: a run that repeats. A task does
   this for its own pages and sends on each run once, with the smallest and
   the largest page and stream of open blocks it stands on.
2. Runs are put together over all tasks. Those in open blocks of two or more
   pages repeat; pages whose open blocks are all equal are copies of one page
   and do not make a run repeat.
3. Tokens of open blocks that a repeated run covers are removed, and the unique
   runs between them are kept. A block that is no heading is also removed if
   such runs and whole runs in boilerplate blocks of other pages cover all of it.

For marked blocks, where articles may quote one another, a repeat counts if it
is the site's template, on more than half of the host's different articles and
on ``SITE`` of them at least:

1. The first token of a block is covered only by the run that starts there, so
   a template is looked for in blocks whose first run starts blocks on so many
   articles.
2. The tokens of these blocks of the different articles are indexed by a suffix
   array as above, and the articles a run stands on are added up over all tasks.
   Articles with half of their tokens or more in such blocks do not count: they
   are near copies of each other.
3. A marked block that is no heading is removed if runs on so many articles cover
   all of it. If nothing of the marked text were left, all of it stays.

So no host is ever gathered in one task, and a run repeats or not whatever
the division into tasks. An open block shorter than ``RUN`` tokens is one run; a
marked one stays.

Readers' comments mark no article, not even as ``article`` elements. A tag that
is not closed before the next one starts stays text. The work grows with the
length of a page, whatever is broken in it.

An empty table gives an empty one. A null page is empty. Repeated rows with the same id count as one page. Pages
with a null id count as one page. Pages without a host share one. White space
inside a block becomes one space; blocks are joined by one space.
"""

import hashlib
import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from acuity.llm import store
from acuity.llm.joins import join_grouped
from acuity.llm.words import mix

LARGEST = (1 << 63) - 1
RUN = 8  # a power of two: suffix ranks double
SITE = 3  # articles that show a site's template at least
# fixed values: element names and the words that mark boilerplate
RAW = ("script", "style", "template", "textarea", "noscript", "svg", "iframe", "title", "select", "object", "canvas")
DROPPED = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "head"))
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot
th thead tr ul""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NESTED = frozenset("""article aside blockquote body details dialog div dl fieldset figure footer form head header html main menu nav
ol section table ul span""".split())
MARKS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination
popup promo promotion promoted related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget
widgets""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
# outside quotes a tag ends where the next one starts: an unterminated tag is read once and stays text
_INSIDE = r"(?:[^<>\"']|<(?![A-Za-z/!?])|\"[^\"]*\"|'[^']*')*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + rf")\b{_INSIDE}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>{_INSIDE})>|<[!?/][^<>]*+>", re.S | re.I)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Za-z]+")
LEAVES = frozenset("p li dd dt h1 h2 h3 h4 h5 h6 a figcaption".split())  # flagged by exact names only
REMARKS = frozenset(("comment", "comments", "commentlist", "reply", "replies"))  # readers' words, by the first word of a class or id
MAIN, BOILER, OPEN = 0, 1, 2
HARD, SOFT, HINT = 1, 2, 3  # flagged by tag, role or hidden; by a class or id; by a word of a compound class or id


def _remarks(attrs: str) -> bool:
    """Whether an element holds readers' comments by its class or id."""
    return any(not REMARKS.isdisjoint(_WORD.findall(name)[:1]) for n, *v in _ATTR.findall(attrs) if n.lower() in ("class", "id")
               for name in "".join(v).lower().split())


def _verdict(tag: str, attrs: str, in_article: bool, in_remarks: bool = False) -> tuple[int, bool]:
    """Flag of an element (0: none), and whether it marks the article. A reader's comment marks none."""
    main = tag in ("article", "main")
    if tag == "article" and (in_remarks or _remarks(attrs)):
        return SOFT, False
    if tag in DROPPED or (tag == "header" and not in_article):
        return HARD, False
    if not attrs or attrs.isspace():
        return 0, main
    given: dict[str, str] = {}
    for name, *values in _ATTR.findall(attrs):
        given.setdefault(name.lower(), "".join(values).lower())
    main |= "main" in given.get("role", "").split()
    if tag in ("html", "body"):
        return 0, main
    if "hidden" in given or not ROLES.isdisjoint(given.get("role", "").split()):
        return HARD, False
    names = f"{given.get('class', '')} {given.get('id', '')}"
    if main or names == " ":
        return 0, main
    if not MARKS.isdisjoint(names.split()):
        return SOFT, False
    return (0 if MARKS.isdisjoint(_WORD.findall(names)) else HINT), False


def blocks(page: str) -> list[tuple[int, str]]:
    """(MAIN, BOILER or OPEN, text) of each block that has text, in page order."""
    return [(kind, text) for kind, _, text in headed_blocks(page)]


def headed_blocks(page: str) -> list[tuple[int, bool, str]]:
    """(MAIN, BOILER or OPEN, whether it is a heading, text) of each block that has text, in page order.

    Classes and ids flag neither an article nor what is around it, unless the
    page has another article; a compound one inside an article leaves its
    blocks open.
    """
    # 0: no flag, 1: flagged around the article only, 2: flagged; article depth > 0; hint; heading; text
    out: list[tuple[int, bool, bool, bool, str]] = []
    stack: list[tuple[str, int, bool, bool]] = []
    opened: Counter[str] = Counter()  # how many of each tag the stack has: an end tag without a start costs nothing
    remarks = 0
    depths = [0] * 4  # hard flags, soft ones around the article, soft ones in it, hints in it
    article = at = 0
    heading = False
    parts: list[str] = []

    def close():
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            out.append((2 if depths[0] or depths[2] or (depths[1] and not article) else int(depths[1] > 0), article > 0, depths[3] > 0, heading, text))

    def pop(depth):
        nonlocal article, remarks
        for name, place, main, remark in stack[depth:]:
            opened[name] -= 1
            if place:
                depths[place - 1] -= 1
            article -= main
            remarks -= remark
        del stack[depth:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS or tag in DROPPED:
            close()
            heading = tag in HEADINGS and not m["end"]
        if stack and not m["end"] and ((tag in BLOCKS and stack[-1][0] in LEAVES - {"li", "a"}) or (tag == "li" and stack[-1][0] == "li")):
            pop(len(stack) - 1)  # a paragraph or heading ends where a block starts, an entry where the next one does
        if tag not in NESTED and tag not in LEAVES or tag in VOID:
            continue
        if m["end"]:
            if not opened[tag] or (tag == "span" and stack[-1][0] != "span"):
                continue
            depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
            if any(place for _, place, *_ in stack[depth:]):
                close()
            pop(depth)
        elif not m["attrs"].endswith("/") and (tag in NESTED or m["attrs"]):
            flag, main = _verdict(tag, m["attrs"], article > 0, remarks > 0)
            if tag in LEAVES and flag not in (HARD, SOFT):
                continue
            remark = _remarks(m["attrs"])
            place = 1 if flag == HARD else 0 if not flag else (3 if flag == SOFT else 4) if article else 2 if flag == SOFT else 0
            if place and tag in ("span", "a"):
                close()
            stack.append((tag, place, main, remark))
            opened[tag] += 1
            remarks += remark
            if place:
                depths[place - 1] += 1
            article += main
    if at < len(page):
        parts.append(page[at:])
    close()
    best = min((bad for bad, main, *_ in out if main), default=2)
    return [(BOILER if bad == 2 or bad > best or (best < 2 and not main) or (best == 2 and bad) else MAIN if best < 2 and not hint else OPEN, head, text)
            for bad, main, hint, head, text in out]


def _hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of tokens."""
    joined = "\n".join([*tokens, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(codes)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat(mix(codes * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)), starts) if len(codes) else codes


def run_hashes(sizes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the run at each place of a token stream, and how many tokens it has.

    ``sizes`` are the numbers of tokens of the blocks. A run has ``RUN`` tokens
    or is a whole shorter block; other places, too near to the end of their
    block, have none (0).
    """
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(tokens))
    first = np.zeros(len(tokens), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    length = np.where(left >= RUN, RUN, np.where(first, left, 0))
    padded = np.concatenate([tokens, np.zeros(RUN, np.uint64)])
    total = length.astype(np.uint64)
    for k in range(RUN):
        total = mix(total + np.where(k < length, padded[k:k + len(tokens)], np.uint64(0)))
    return total, length


def suffix_groups(sizes: np.ndarray, tokens: np.ndarray, host: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the joined token streams, host by host, and where the groups of equal runs start in it.

    Prefix doubling: the rank of a suffix by its first 2 k tokens follows from
    its rank by k tokens and that of the suffix k places on. Ranks stop at
    ``RUN`` tokens, where equal ranks are common prefixes of a whole run; the
    end of a block sorts before every token. Only ``wanted`` suffixes are kept.
    """
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(tokens))
    rank = np.unique(tokens, return_inverse=True)[1] + 1
    k = 1
    while k < RUN:
        after = np.zeros(len(rank), np.int64)
        after[:len(rank) - k] = rank[k:]
        after[left <= k] = 0
        rank = np.unique(rank * np.int64(len(rank) + 1) + after, return_inverse=True)[1] + 1
        k *= 2
    order = np.lexsort((rank, host))
    order = order[wanted[order]]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (rank[order[1:]] != rank[order[:-1]]) | (host[order[1:]] != host[order[:-1]])
    return order, np.flatnonzero(fresh)


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens of some blocks and the hashes of their joined tokens."""
    split = [t.split() for t in texts]
    return np.array([len(s) for s in split], np.int64), _hashes([t for s in split for t in s])


def _first_runs(pages: list[list[str]]) -> list[np.ndarray]:
    """Per page: the runs that start its blocks of ``RUN`` tokens or more."""
    starts = [[w[:RUN] for w in (t.split(None, RUN) for t in texts) if len(w) >= RUN] for texts in pages]
    sizes = np.full(sum(map(len, starts)), RUN)
    tokens = _hashes([t for page in starts for words in page for t in words]) if len(sizes) else np.zeros(0, np.uint64)
    runs = run_hashes(sizes, tokens)[0][::RUN].view(np.int64)
    return np.split(runs, np.cumsum([len(page) for page in starts])[:-1])


def _parsed(batches):
    for batch in batches:
        found = [headed_blocks(page or "") for page in batch.column(3).to_pylist()]
        if not found:
            continue
        marked = [[t for kind, _, t in page if kind == MAIN] for page in found]
        firsts = _first_runs([[t for kind, head, t in page if kind == MAIN and not head] for page in found])
        yield pa.RecordBatch.from_pydict({
            "page_id": batch.column(0), "url": batch.column(1), "host": batch.column(2),
            "kinds": pa.array([[kind for kind, _, _ in page] for page in found], pa.list_(pa.int8())),
            "heads": pa.array([[head for _, head, _ in page] for page in found], pa.list_(pa.bool_())),
            "texts": pa.array([[t for _, _, t in page] for page in found], pa.list_(pa.string())),
            "stream": pa.array([_stream_id(texts) if texts else None for texts in marked], pa.int64()),
            "firsts": pa.array([np.unique(f) for f in firsts], pa.list_(pa.int64()))})


def _stream_id(texts: list[str]) -> int:
    """The same number for pages with the same open, or marked, blocks."""
    return int.from_bytes(hashlib.blake2b("\n".join(texts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _task_runs(batches):
    """Each run of a host once per task, with the least and the largest page and stream of its open places and page of the others."""
    for batch in batches:
        hosts, place = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        pages = batch.column(1).to_numpy()
        texts, owner, is_open, streams = [], [], [], []
        for row, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            texts += [*a, *b]
            owner += [row] * (len(a) + len(b))
            is_open += [True] * len(a) + [False] * len(b)
            streams.append(_stream_id(a))
        if not texts:
            continue
        sizes, tokens = _stream(texts)
        runs, length = run_hashes(sizes, tokens)
        row, opened = np.repeat(np.array(owner), sizes), np.repeat(np.array(is_open), sizes)
        # a short block counts only where it is open: a menu that names a heading does not make it boilerplate
        order, starts = suffix_groups(sizes, tokens, place[row], (length == RUN) | (opened & (length > 0)))
        if not len(order):
            continue
        out = {"host": pa.array(hosts[place[row[order[starts]]]]), "run": pa.array(runs[order[starts]].view(np.int64))}
        for name, values, here in (("page", pages[row[order]], opened[order]), ("stream", np.array(streams)[row[order]], opened[order]),
                                   ("other", pages[row[order]], ~opened[order])):
            none = ~np.logical_or.reduceat(here, starts)
            out[f"low_{name}"] = pa.array(np.minimum.reduceat(np.where(here, values, LARGEST), starts), mask=none)
            out[f"high_{name}"] = pa.array(np.maximum.reduceat(np.where(here, values, -LARGEST - 1), starts), mask=none)
        yield pa.RecordBatch.from_pydict(out)


def _open_runs(batches):
    for batch in batches:
        for key, host, page, texts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            runs, length = run_hashes(*_stream(texts))
            runs = np.unique(runs[length > 0]).view(np.int64)
            yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(runs), pa.int64()), "host": pa.array([host] * len(runs), pa.int64()),
                                              "page": pa.array([page] * len(runs), pa.int64()), "run": pa.array(runs)})


def _starting_blocks(batches):
    """The blocks of a page that start as its host's template does, none if they hold half of its marked tokens."""
    for batch in batches:
        out = []
        for kinds, heads, texts, starts in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            marked = [t for kind, head, t in zip(kinds, heads, texts) if kind == MAIN and not head]
            here = [t for t, first in zip(marked, _first_runs([[t] for t in marked])) if np.isin(first, starts).any()]
            size = sum(len(t.split()) for kind, t in zip(kinds, texts) if kind == MAIN)
            out.append(here if 2 * sum(len(t.split()) for t in here) < size else [])
        yield pa.RecordBatch.from_pydict({"key": batch.column(0), "host": batch.column(1), "blocks": pa.array(out, pa.list_(pa.string()))})


def _template_runs(batches):
    """Each run of a host in such blocks once per batch, with the number of rows it stands on."""
    for batch in batches:
        hosts, place = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        rows = batch.column(1).to_pylist()
        texts, owner = [t for row in rows for t in row], [i for i, row in enumerate(rows) for _ in row]
        if not texts:
            continue
        sizes, tokens = _stream(texts)
        runs, length = run_hashes(sizes, tokens)
        row = np.repeat(np.array(owner), sizes)
        order, starts = suffix_groups(sizes, tokens, place[row], length == RUN)
        group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(order)]))
        once = np.unique(group * np.int64(len(batch)) + row[order]) // len(batch)
        yield pa.RecordBatch.from_pydict({"host": pa.array(hosts[place[row[order[starts]]]]), "run": pa.array(runs[order[starts]].view(np.int64)),
                                          "n": pa.array(np.bincount(once, minlength=len(starts)))})


def _covered(texts: list[str], *some: list[int] | np.ndarray) -> list[list[np.ndarray]]:
    """For each list of runs: which tokens of each block they cover."""
    sizes, tokens = _stream(texts)
    runs, length = run_hashes(sizes, tokens)
    out = []
    for wanted in some:
        hit = np.flatnonzero(np.isin(runs, np.array(wanted, np.int64).view(np.uint64)) & (length > 0))
        cover = np.zeros(len(runs) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + length[hit], -1)
        out.append(np.split(np.cumsum(cover)[:-1] > 0, np.cumsum(sizes)[:-1]))
    return out


def page_text(kinds: list[int], heads: list[bool], texts: list[str], repeated: list[int], others: list[int], template: np.ndarray) -> str:
    """The marked blocks of a page that are no template, and the tokens of its open blocks that no repeated run covers.

    An open block that is no heading goes whole if it is covered by repeated
    runs and by those that other pages mark as boilerplate.
    """
    kept = {i: text for i, (kind, text) in enumerate(zip(kinds, texts)) if kind == MAIN}
    if kept and len(template):
        cover, = _covered(list(kept.values()), template)
        left = {i: text for (i, text), c in zip(kept.items(), cover) if heads[i] or not c.all()}
        kept = left or kept
    opened = [i for i, kind in enumerate(kinds) if kind == OPEN]
    if opened:
        for i, gone, all_gone in zip(opened, *_covered([texts[i] for i in opened], repeated, [*repeated, *others])):
            if heads[i] or not all_gone.all():
                kept[i] = " ".join(t for t, g in zip(texts[i].split(), gone.tolist()) if not g)
    return " ".join(filter(None, (kept[i] for i in sorted(kept))))


def _assembled(batches):
    none = np.zeros(0, np.int64)
    for batch in batches:
        templates = (none if runs.values is None else runs.values.to_numpy() for runs in batch.column("template"))
        texts = [page_text(k, h, t, r or [], o or [], m) for k, h, t, r, o, m in zip(
            *(batch.column(c).to_pylist() for c in ("kinds", "heads", "texts", "repeated", "marked")), templates)]
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string())})


def _templates(parsed: DataFrame) -> DataFrame:
    """host, template: the runs of the host's template in marked articles."""
    # one row for each different article: copies of a page and rows with its id count once
    articles = store.write(
        parsed.filter("stream is not null").groupBy("host", "page").agg(F.min(F.struct("stream", "key", "firsts")).alias("least"))
        .groupBy("host", F.col("least.stream").alias("stream")).agg(F.min(F.struct("least.key", "least.firsts")).alias("least"))
        .select("host", "least.key", "least.firsts"))
    total = articles.groupBy("host").agg(F.count("*").alias("total"))

    def site(counts: DataFrame, name: str) -> DataFrame:
        """A host's runs on more than half of its articles: at most twice the runs of a mean article. Written, so that Spark knows the size."""
        often = join_grouped(counts.filter(F.col("n") >= SITE), total, ["host"]).filter("2 * n > total")
        return store.write(often.groupBy("host").agg(F.collect_list("run").alias(name)))

    starts = site(articles.select("host", F.explode("firsts").alias("run")).groupBy("host", "run").agg(F.count("*").alias("n")), "starts")
    found = (parsed.join(starts, "host").filter(F.arrays_overlap("firsts", "starts"))
             .select("key", "host", "kinds", "heads", "texts", "starts").mapInArrow(_starting_blocks, "key long, host long, blocks array<string>"))
    runs = found.join(articles.select("key"), "key").select("host", "blocks").mapInArrow(_template_runs, "host long, run long, n long")
    return site(runs.groupBy("host", "run").agg(F.sum("n").alias("n")), "template")


def main_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.xxhash64(F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))
        .alias("host"), F.col("html").cast("string").alias("html"))
    kind = "page_id long, url string, host long, kinds array<byte>, heads array<boolean>, texts array<string>, stream long, firsts array<long>"
    parsed = store.write(rows.mapInArrow(_parsed, kind).withColumn("key", F.monotonically_increasing_id())
                         .withColumn("page", F.coalesce("page_id", F.lit(-1))).withColumn("open", F.array_contains("kinds", F.lit(OPEN).cast("byte"))))
    opens, others = (F.expr(f"filter(texts, (t, i) -> kinds[i] = {kind})").alias(name) for kind, name in ((OPEN, "opens"), (BOILER, "others")))
    ends = [f"{end}_{name}" for name in ("page", "stream", "other") for end in ("low", "high")]
    runs = parsed.select("host", "page", opens, others).mapInArrow(_task_runs, f"host long, run long, {' long, '.join(ends)} long")
    repeated = (runs.groupBy("host", "run").agg(*[(F.min if c.startswith("low") else F.max)(c).alias(c) for c in ends])
                .filter("low_page is not null")
                .selectExpr("host", "run", "low_page < high_page and low_stream < high_stream as shared", "low_other", "high_other")
                .filter("shared or low_other is not null"))
    open_ = parsed.filter("open")
    opened = open_.select("key", "host", "page", opens).mapInArrow(_open_runs, "key long, host long, page long, run long")
    covered = (join_grouped(opened, repeated, ["host", "run"])
               .groupBy("key").agg(F.collect_set(F.expr("if(shared, run, null)")).alias("repeated"),
                                   F.collect_set(F.expr("if(low_other <> page or high_other <> page, run, null)")).alias("marked")))
    columns = ["key", "host", "page_id", "url", "kinds", "heads", "texts"]
    none = F.lit(None).cast("array<long>")
    judged = (parsed.filter("not open").select(*columns, none.alias("repeated"), none.alias("marked"))
              .unionAll(open_.join(covered, "key", "left").select(*columns, "repeated", "marked"))
              .join(_templates(parsed), "host", "left").drop("key", "host"))
    return judged.mapInArrow(_assembled, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
