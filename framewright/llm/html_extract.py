"""Main text of pages by template deduction over the pages of a host.

Pages are tokens: tags under their path, and texts under the place where they stand. A token's occurrence vector
says how often it is on each page of its host. Tokens with the same vector are an equivalence class; a class is
valid if it is large and frequent enough, if its tokens follow each other in one order on every page (tokens out of
order leave it), and if it is nested: it crosses no class that is on more pages. Tags that are once on each page of a valid class are anchors. In a second round tags between
anchors have the role of their gap, so that an element that comes twice is told apart by where it comes, and
their classes are nested in that gap. What lies behind an anchor under one path is a slot.

A text is the template's if it is in a valid class and on a share of the pages that have its slot; slots that consist of
links are menus. The main text of a page is what its slots hold without these. Names (of elements, classes and roles) are
evidence: furniture is out; where a page has an article or main element, slots outside of it are out, and
of the template's texts in it only those that are all that a plain container ever holds (notices) are left out.

Vectors are never built: a token's vector is summed up as two random linear sums over pages, equal for equal
vectors and for few others. So all pages of a host count, and no task sees them together. Pages that hold the
same texts count once, as copies say nothing of the template.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from framewright.llm.common import chunks, mix, read, stage

#: Tokens of a valid class and pages of a host with it, at least; share of a slot's pages that a text of the template is on.
CLASS_TOKENS, CLASS_PAGES, CLASS_SHARE = 2, 3, 0.5
#: Share of a block's characters in links from which on it is an item of a menu; of a slot's, from which on its other blocks are too.
LINK_SHARE, MENU_SHARE = 0.5, 0.9
#: Share of the characters in a host's articles that notices may have; with more they are no notices but articles that are alike.
NOTICE_SHARE = 0.25
#: Pages that a notice is on, at least; on fewer, a text of an article may be the same by chance.
NOTICE_PAGES = 5
#: Characters of a path; longer ones are shortened to a hash, so that deep pages don't grow with the square of their depth.
PATH_CHARS = 400
#: Rows of templates that may be broadcast; more are joined by a shuffle, with salted hosts.
BROADCAST_ROWS, SALTS = 200_000, 16

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select option".split())
TEXT_ONLY = frozenset("script style textarea title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body caption html legend tbody td tfoot th thead tr summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOT_MAIN = frozenset("nav header footer aside form menu head button dialog search".split()) | RAW
NOT_MAIN_WORDS = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related reply replies respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
#: Words that a name of NOT_MAIN_WORDS may have beside it, as in site-footer or share-buttons; with any other word (share-price) it names content.
BESIDE = frozenset("area bar block bottom box button buttons container content fixed form global group icon icons inner item items left link links list main module outer page panel post posts primary region right secondary section site slot text top unit wrap wrapper".split())
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

#: Elements that say nothing of what they hold.
PLAIN = frozenset(["", "body", "center", "div", "section"])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+|[0-9]+")
_END = {name: re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I) for name in RAW}
_BLOCK = re.compile(f"</?(?:{'|'.join(sorted(BLOCKS))})(?=[\\s/>])", re.I)


class Node:
    """An open element: path, whether it is in the article, is excluded, is a link."""

    __slots__ = ("name", "path", "article", "out", "link", "heading")

    def __init__(self, name, path, article, out, link, heading):
        self.name, self.path, self.article, self.out, self.link, self.heading = name, path, article, out, link, heading


def names_furniture(text: str) -> bool:
    """Whether one of the names in a class or id attribute is made up of NOT_MAIN_WORDS, with nothing but numbers and words BESIDE them."""
    for name in text.lower().split():
        words = [w for w in _NAME.findall(name) if not w.isdigit()]
        if any(w in NOT_MAIN_WORDS for w in words) and all(w in NOT_MAIN_WORDS or w in BESIDE for w in words):
            return True
    return False


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}


def parse(page: str) -> tuple[list[str], list[tuple]]:
    """Tag tokens of a page, and its blocks: (path of the block, in article, excluded, text, characters in links, tags before it, in a plain container).

    The parser follows HTML where it matters for text: comments, raw text elements, void elements, quoted
    attributes, unclosed paragraphs and list items, inline elements that are never closed.
    """
    tags: list[str] = []
    blocks: list[tuple] = []
    root = Node("", "", False, False, False, False)
    stack = [root]
    parts: list[str] = []
    linked = 0
    begun = -1

    def flush():
        nonlocal linked, begun
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                top = next(n for n in reversed(stack) if n.name in BLOCKS or n.name in NOT_MAIN or n is root)
                blocks.append((top.path, top.article, top.out or stack[-1].out, text, linked, max(begun, 0), top.name in PLAIN))
            parts.clear()
        linked, begun = 0, -1

    def close(k: int):
        if any(n.name in BLOCKS or n.out for n in stack[k:]):
            flush()
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                parts.append(piece)
                if begun < 0 and not piece.isspace():
                    begun = len(tags)
                if stack[-1].link:
                    linked += len(piece.strip())
            elif piece.startswith("<![CDATA["):
                pass
            continue
        name = name.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    tags.append("/" + stack[k].path)
                    close(k)
                    break
                if stack[k].name in ("article", "body", "html", "td", "th") and name not in BLOCKS:
                    break  # an inline end tag doesn't reach beyond these
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    close(k)
                    break
                if stack[k].name in BLOCKS:
                    break
        for same, stop in ((("li",), ("ul", "ol", "menu")), (("dt", "dd"), ("dl",)), (("option",), ("select",)), (("tr",), ("table",)), (("td", "th"), ("tr", "table"))):
            if name in same:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in same:
                        close(k)
                        break
                    if stack[k].name in stop:
                        break
        attributes = _attributes(m[3])
        furniture = names_furniture(attributes.get("class", "")) or names_furniture(attributes.get("id", ""))
        label = name + "".join("." + w for w in sorted(set(attributes.get("class", "").split()))[:4])
        top = stack[-1]
        if name == "br":
            parts.append(" ")
        if name in BLOCKS:
            flush()
        within = name in ("article", "main") or attributes.get("role") in ("main", "article")
        article = top.article or (within and not top.out)
        out = top.out or (name in NOT_MAIN and not (name == "header" and top.article)) or furniture and name not in ("html", "body") and not within or attributes.get("role", "").lower() in NOT_MAIN_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
        path = f"{top.path}>{label}"
        if len(path) > PATH_CHARS:
            path = f">~{_text_key(path)}"
        tags.append(path)
        if name in VOID:
            continue
        if name in RAW:
            # Everything up to the end tag is no markup. Without one, a text element takes the rest; others end at the next block.
            found = _END[name].search(page, at)
            if parts and name in BLOCKS:
                flush()
            if found is None:
                following = None if name in TEXT_ONLY else _BLOCK.search(page, at)
                if following is None:
                    break
                at = following.start()
                continue
            end = found.start()
            body = page[at:end]
            if name == "title" and body.strip():
                blocks.append((path, False, True, " ".join(entities.unescape(body).split()), 0, len(tags), False))
            at = page.find(">", end) + 1 or n
            continue
        if out and not top.out:
            flush()
        stack.append(Node(name, path, article, out, top.link or name == "a", top.heading or name in HEADINGS))
    flush()
    return tags, [b for b in blocks if b[3]]


def _text_key(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def host_of():
    return lambda url: F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


# ---- pages as sequences of tokens ---------------------------------------------------------------------------


def _id(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@functools.lru_cache(1 << 17)
def _path_id(host: str, path: str) -> int:
    return _id(host, path)


def _digest(values: list[int]) -> int:
    return int.from_bytes(hashlib.blake2b(np.array(values, dtype=np.int64).tobytes(), digest_size=8).digest(), "big", signed=True)


def _refine(x, gap):
    """The role of tokens x in the gap behind an anchor."""
    x, gap = np.asarray(x, dtype=np.int64).view(np.uint64), np.asarray(gap, dtype=np.int64).view(np.uint64)
    return mix(x ^ mix(gap + np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def sequence(host: str, tags: list[str], blocks: list[tuple]) -> tuple[list[int], list[int], list[int]]:
    """Ids of a page's tokens in page order, the places of the texts among them, and ids of the texts' paths. Ids hold the host."""
    seq: list[int] = []
    at: list[int] = []
    paths: list[int] = []
    done = 0
    for path, _, _, text, _, place, _ in blocks:
        seq.extend(_path_id(host, t) for t in tags[done:place])
        done = max(done, place)
        at.append(len(seq))
        paths.append(_path_id(host, path))
        seq.append(_id(host, path, "#", text))
    seq.extend(_path_id(host, t) for t in tags[done:])
    return seq, at, paths


SKELETON = "host string, main long, whole long, seq array<long>, at array<int>, path array<long>, chars array<int>, linked array<int>, article array<boolean>, plain array<boolean>"


def skeletons(pages: DataFrame, url: str, html_col: str) -> DataFrame:
    """The pages' tokens without those of excluded texts; of a host's pages with equal texts under equal paths, one."""
    fields = T.StructType.fromDDL(SKELETON)

    def run(batches):
        for batch in chunks(batches, "html", 4_000_000):
            rows = []
            for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tags, blocks = parse(page or "")
                blocks = [b for b in blocks if not b[2]]
                seq, at, paths = sequence(host, tags, blocks)
                own = _digest([seq[i] for i in at] or seq)
                rows.append((host, own, _digest(seq), seq, at, paths, [len(b[3]) for b in blocks], [min(b[4], len(b[3])) for b in blocks], [b[1] for b in blocks], [b[6] for b in blocks]))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], names=fields.names)

    p = pages.select(host_of()(url).alias("host"), F.col(html_col).alias("html"))
    rest = [f.name for f in fields[2:]]
    return p.mapInArrow(run, fields).groupBy("host", "main").agg(F.min(F.struct(*rest)).alias("s")).select("host", "main", *[f"s.{c}" for c in rest])


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row's begin, one longer."""
    first = np.zeros(len(column) + 1, dtype=np.int64)
    np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), out=first[1:])
    return column.flatten().to_numpy(zero_copy_only=False), first


def _behind(mark: np.ndarray, begin: np.ndarray, role: np.ndarray) -> np.ndarray:
    """For each token the role of the last marked one up to it on its page, or 0."""
    last = np.maximum.accumulate(np.where(mark, np.arange(len(mark)), -1))
    return np.where(last >= begin, role[np.maximum(last, 0)], 0)


def walk(seq: np.ndarray, begin: np.ndarray, text: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Roles of the tokens behind anchors of the first round, and these (0 for anchors); which are anchors of either round; the last anchor up to each."""
    if not len(seq):
        return seq, seq, text, seq
    one = np.isin(seq, first) & ~text
    gap = np.where(one | text, 0, _behind(one, begin, seq))
    role = np.where(one | text, seq, _refine(seq, gap))
    anchor = one | (np.isin(role, second) & ~text)
    return role, gap, anchor, _behind(anchor, begin, role)


#: Arrays of a host's template: anchors of both rounds, texts that are left out (in articles), and slots that are menus.
PARTS = ("first", "second", "fixed", "notices", "menus")


def with_parts(df: DataFrame, host: str, parts: DataFrame, packed: DataFrame, salt: list) -> DataFrame:
    """df with each host's arrays: by broadcast, or, beyond BROADCAST_ROWS rows of parts, by a join on host and salt."""
    packed = packed.withColumnRenamed("host", host)
    if parts.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(packed), host, "left")
    spread = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int")).join(spread, [host, "_salt"], "left").drop("_salt")


def _cut(batches, most: int = 1_000_000):
    """Batches of skeletons cut so that each has at most so many tokens, or is a single page."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(batch.schema.get_field_index("seq"))).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


class Pages:
    """A batch of skeletons with the anchors of their hosts: tokens with their roles in a round, page by page."""

    def __init__(self, batch: pa.RecordBatch, turn: int):
        column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        self.hosts = column["host"].to_pylist()
        self.seq, self.at = _values(column["seq"])
        size = np.diff(self.at)
        self.page = np.repeat(np.arange(len(size)), size)
        begin = self.at[:-1][self.page]
        place, first = _values(column["at"])
        self.block = place + np.repeat(self.at[:-1], np.diff(first))
        self.text = np.zeros(len(self.seq), dtype=bool)
        self.text[self.block] = True
        one, two = (np.unique(_values(column[c])[0]) if c in column else np.zeros(0, np.int64) for c in ("first", "second"))
        self.role, self.used, self.slot, self.gap = self.seq, ~self.text, None, None
        if turn > 1:
            self.role, self.gap, anchor, last = walk(self.seq, begin, self.text, one, two)
            if turn == 3:
                # Texts in their slots, and anchors.
                self.slot = _refine(_values(column["path"])[0], last[self.block])
                self.role = self.role.copy()
                self.role[self.block] = _refine(self.seq[self.block], self.slot)
                self.used = anchor | self.text
        self.column = column


SUMS = "host string, kind string, role long, slot long, pages long, times long, sum1 long, sum2 long, place long, chars long, linked long, article long, plain long"


def _sums(p: Pages, kind: str, page, role, place, slot=None, **more) -> pa.RecordBatch:
    """Sums of each role over the pages of a batch."""
    main = p.column["main"].to_numpy(zero_copy_only=False).view(np.uint64)
    r1, r2 = ((main >> np.uint64(k)) & np.uint64(0xFFFFFF) for k in (0, 24))
    order = np.lexsort((role, page))
    role_, page_ = role[order], page[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (role_[1:] != role_[:-1]) | (page_[1:] != page_[:-1])
    start = np.flatnonzero(new)
    times = np.diff(np.append(start, len(order)))
    found, which, back = np.unique(role_[start], return_index=True, return_inverse=True)

    def total(values):
        out = np.zeros(len(found), dtype=np.int64)
        np.add.at(out, back, values)
        return out

    on = page_[start]
    sums = [total(1), total(times), total(times * r1[on].astype(np.int64)), total(times * r2[on].astype(np.int64)), total(place[order][start])]
    sums += [total(np.add.reduceat(more[c][order].astype(np.int64), start)) if c in more and len(start) else np.zeros(len(found), np.int64) for c in ("chars", "linked", "article", "plain")]
    at = order[start[which]] if len(found) else which
    columns = [pa.array([p.hosts[i] for i in page[at]], pa.string()), pa.array([kind] * len(found), pa.string()), pa.array(found), pa.array(slot[at] if slot is not None else np.zeros(len(found), np.int64)), *[pa.array(x) for x in sums]]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SUMS.split(", ")])


def vectors(known: DataFrame, turn: int) -> DataFrame:
    """For each host and role: pages with it, occurrences, the two sums of its vector, the sum of its places; of texts and slots their characters too."""
    def run(batches):
        for batch in _cut(batches):
            p = Pages(batch, turn)
            rows = np.arange(batch.num_rows)
            by_host = np.array([_path_id(h, "") for h in p.hosts], dtype=np.int64)
            yield _sums(p, "page", rows, by_host, rows * 0)
            tag = p.used & ~p.text
            yield _sums(p, "tag", p.page[tag], p.role[tag], (np.arange(len(p.seq)) - p.at[:-1][p.page])[tag], p.gap[tag] if turn == 2 else None)
            if turn == 3:
                more = {c: _values(p.column[c])[0] for c in ("chars", "linked")}
                flags = {c: _values(p.column[c])[0].astype(np.int64) for c in ("article", "plain")}
                more |= {"article": flags["article"] * more["chars"], "plain": flags["plain"] * flags["article"]}
                page = p.page[p.block]
                yield _sums(p, "text", page, p.role[p.block], p.block - p.at[:-1][page], p.slot, **more)
                yield _sums(p, "slot", page, p.slot, page * 0, **more)

    names = [x.split()[0] for x in SUMS.split(", ")]
    return known.mapInArrow(run, SUMS).groupBy(*names[:4]).agg(*[F.sum(c).alias(c) for c in names[4:]])


#: What a class's tokens share: the vector; of tags also the gap that they are in (slot).
VECTOR = ["host", "pages", "sum1", "sum2"]
NESTED = [*VECTOR, "slot"]


def classes(sums: DataFrame, key: list[str]) -> DataFrame:
    """Tags and texts in classes of CLASS_TOKENS tokens, equal in key, on CLASS_PAGES pages of a host: with the class, and depth 0 if they are once on every page."""
    total = sums.where("kind = 'page'").select("host", F.col("sum1").alias("f1"), F.col("sum2").alias("f2"))
    frequent = sums.where((F.col("kind").isin("tag", "text")) & (F.col("pages") >= CLASS_PAGES))
    size = frequent.groupBy(*key).agg(F.count("*").alias("tokens"), F.min("role").alias("class")).where(F.col("tokens") >= CLASS_TOKENS)
    return frequent.join(size.drop("tokens"), key).join(total, "host").withColumn("depth", F.when((F.col("sum1") == F.col("f1")) & (F.col("sum2") == F.col("f2")), 0).otherwise(1)).drop("f1", "f2")


def _out_of_order(keys: list[int]) -> list[int]:
    """Places outside of a longest rising part of keys."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, k in enumerate(keys):
        j = bisect.bisect_left(tails, k)
        before.append(ends[j - 1] if j else -1)
        if j == len(tails):
            tails.append(k)
            ends.append(i)
        else:
            tails[j], ends[j] = k, i
    kept, i = set(), ends[-1]
    while i >= 0:
        kept.add(i)
        i = before[i]
    return [i for i in range(len(keys)) if i not in kept]


def _crosses(x: list[int], y: list[int]) -> bool:
    """Whether places x and y of two classes on a page interleave: neither is in one gap of the other."""
    return bisect.bisect(y, x[0]) != bisect.bisect(y, x[-1]) and bisect.bisect(x, y[0]) != bisect.bisect(x, y[-1])


def ordered(known: DataFrame, found: DataFrame, turn: int, settled: DataFrame | None = None) -> DataFrame:
    """found without tokens of once a page that aren't in their class's order on some page, without classes of tags that cross
    one on more pages, and without the classes that this leaves too small.

    The order is that of the mean places. On a page out of order the fewest tokens that mend it go; settled anchors never do.
    Texts (turn 3) are in their slots, so they are nested.
    """
    once = found.where("times = pages").select("host", "role", "class", "place", "pages")
    if settled is not None:
        once = once.join(settled.select("host", "role", F.lit(True).alias("settled")), ["host", "role"], "left")
    else:
        once = once.withColumn("settled", F.lit(False))
    once = stage(once.withColumn("settled", F.coalesce("settled", F.lit(False))), "html-order")
    packed = once.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("role", "class", "place", "settled", "pages"))).alias("o")).select("host", *[F.col(f"o.{c}").alias(f"o_{c}") for c in ("role", "class", "place", "settled", "pages")])

    def run(batches):
        for batch in _cut(batches):
            p = Pages(batch, turn)
            rows = pa.array(np.unique(np.array(p.hosts, dtype=object).astype(str), return_index=True)[1])
            role, kind, place, fast, pages = (_values(p.column[c].take(rows))[0] for c in ("o_role", "o_class", "o_place", "o_settled", "o_pages"))
            if not len(role):
                continue
            order = np.argsort(role)
            role, kind, place, fast, pages = role[order], kind[order], place[order], fast[order].astype(bool), pages[order]
            at = np.minimum(np.searchsorted(role, p.role), len(role) - 1)
            hit = np.flatnonzero((role[at] == p.role) & p.used)
            page, token = p.page[hit], at[hit]
            group = np.lexsort((hit, kind[token], page))
            page, token, hit = page[group], token[group], hit[group]
            new = np.ones(len(group), dtype=bool)
            new[1:] = (page[1:] != page[:-1]) | (kind[token[1:]] != kind[token[:-1]])
            falls = np.zeros(len(group), dtype=bool)
            falls[1:] = ~new[1:] & (place[token[1:]] <= place[token[:-1]])
            start = np.append(np.flatnonzero(new), len(group))
            bad, right = set(), np.ones(len(group), dtype=bool)
            for g in np.unique(np.searchsorted(start, np.flatnonzero(falls), side="right") - 1).tolist():
                part = token[start[g] : start[g + 1]]
                wrong = np.array(_out_of_order(place[part].tolist()))
                if fast[part[wrong]].any():
                    wrong = np.flatnonzero(~fast[part])
                right[start[g] + wrong] = False
                bad |= {(p.hosts[page[start[g]]], int(role[t])) for t in part[wrong]}
            of = page[start[:-1]]
            for one in np.flatnonzero(np.bincount(of) > 1).tolist() if turn < 3 and len(of) else ():
                parts = [np.arange(start[g], start[g + 1]) for g in range(*np.searchsorted(of, [one, one + 1]))]
                parts = [x for x in (x[right[x]] for x in parts) if len(x)]
                taken: list[list[int]] = []
                for x in sorted(parts, key=lambda x: (not fast[token[x]].any(), -pages[token[x[0]]], kind[token[x[0]]])):
                    at = hit[x].tolist()
                    if any(_crosses(at, y) for y in taken):
                        bad |= {(p.hosts[one], int(role[t])) for t in token[x] if not fast[t]}
                    else:
                        taken.append(at)
            if bad:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*sorted(bad), strict=True), (pa.string(), pa.int64()), strict=True)], names=["host", "role"])

    bad = stage(with_parts(known, "host", once, packed, ["main"]).mapInArrow(run, "host string, role long").distinct(), "html-disorder")
    kept = found.join(bad, ["host", "role"], "left_anti")
    size = kept.groupBy("host", "class").agg(F.count("*").alias("tokens")).where(F.col("tokens") >= CLASS_TOKENS)
    return kept.join(size.drop("tokens"), ["host", "class"])


def deduce(pages: DataFrame, url: str, html_col: str) -> tuple[DataFrame, DataFrame]:
    """The hosts' templates: tokens in valid classes with kind, class and depth, and a row for each of their PARTS (host, part, role)."""
    known = stage(skeletons(pages, url, html_col), "html-skeletons")

    def anchors(df, name):
        return df.where("kind = 'tag' and times = pages").select("host", F.lit(name).alias("part"), "role")

    def joined(parts):
        packed = parts.groupBy("host").agg(*[F.sort_array(F.collect_list(F.when(F.col("part") == x, F.col("role")))).alias(x) for x in ("first", "second")])
        return with_parts(known, "host", parts, packed, ["main"])

    first = stage(anchors(ordered(known, stage(classes(vectors(known, 1), NESTED), "html-classes"), 1), "first"), "html-first")
    refined = joined(first)
    nested = stage(ordered(refined, stage(classes(vectors(refined, 2), NESTED), "html-classes"), 2, first), "html-nested")
    second = anchors(nested, "second").join(first.select("host", "role"), ["host", "role"], "left_anti")
    settled = stage(first.unionByName(second), "html-anchors")
    refined = joined(settled)
    sums = stage(vectors(refined, 3), "html-slots")
    slots = sums.where("kind = 'slot'")
    of_slot = slots.select("host", F.col("role").alias("slot"), F.col("pages").alias("n"), F.col("chars").alias("full"))
    texts = classes(sums, VECTOR).join(of_slot, ["host", "slot"], "left").where((F.col("kind") == "tag") | (F.col("pages") >= F.col("n") * CLASS_SHARE))
    texts = stage(ordered(refined, stage(texts, "html-texts"), 3, settled).where("kind = 'text'"), "html-fixed")
    # In articles: texts that are all that their slots ever hold, in plain containers, if they are a small part of the articles.
    whole = texts.where((F.col("article") == F.col("chars")) & (F.col("plain") == F.col("times")) & (F.col("pages") >= NOTICE_PAGES)).join(texts.groupBy("host", "slot").agg(F.sum("chars").alias("held")), ["host", "slot"]).where("held = full")
    articles = slots.groupBy("host").agg(F.sum("article").alias("articles"))
    few = whole.groupBy("host").agg(F.sum("chars").alias("notices")).join(articles, "host").where(F.col("notices") <= F.col("articles") * NOTICE_SHARE)
    menus = slots.where((F.col("pages") >= CLASS_PAGES) & (F.col("linked") >= F.col("chars") * MENU_SHARE) & (F.col("chars") > 0))
    parts = settled
    for name, df in (("fixed", texts), ("notices", whole.join(few.select("host"), "host", "left_semi")), ("menus", menus)):
        parts = parts.unionByName(df.select("host", F.lit(name).alias("part"), "role"))
    shown = nested.where("kind = 'tag'").unionByName(texts.select(*nested.columns)).select("host", "role", "kind", "class", "depth", F.lit(0.0).alias("links"), F.col("pages").cast("double").alias("weight"))
    shown = shown.unionByName(menus.select("host", "role", "kind", F.lit(None).cast("long").alias("class"), F.lit(1).alias("depth"), (F.col("linked") / F.col("chars")).alias("links"), F.col("chars").cast("double").alias("weight")))
    return shown, stage(parts, "html-templates")


def _pack(parts: DataFrame) -> DataFrame:
    return parts.groupBy("host").agg(*[F.collect_set(F.when(F.col("part") == x, F.col("role"))).alias(x) for x in PARTS])


def _roles(host: str, tags: list[str], blocks: list[tuple], template: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Roles of a page's tokens, the places of the texts among them, the slots of these, and their roles in them."""
    seq, at, paths = sequence(host, tags, blocks)
    seq, at = np.array(seq, dtype=np.int64), np.array(at, dtype=np.int64)
    text = np.zeros(len(seq), dtype=bool)
    text[at] = True
    none = np.zeros(0, np.int64)
    role, _, _, last = walk(seq, np.zeros(len(seq), np.int64), text, template.get("first", none), template.get("second", none))
    slots = _refine(np.array(paths, dtype=np.int64), last[at])
    return role, at, slots, _refine(seq[at], slots)


def templates(pages: DataFrame, url: str = "url", html_col: str = "html", key: str = "page_id") -> DataFrame:
    """host, token, kind (tag, text or slot), class, depth, share of links, weight: each host's template.

    Tokens of equal vectors are a class. Valid are classes of CLASS_TOKENS tokens on CLASS_PAGES pages in one order.
    depth is 0 for the class of what is once on every page, 1 for classes nested in it. Of the slots, menus are
    listed with their share of characters in links. Tokens are named by their paths, texts with a hash.
    """
    shown, parts = deduce(pages, url, html_col)

    def run(batches):
        for batch in chunks(batches, "html", 4_000_000):
            out = set()
            for host, page, *found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tags, blocks = parse(page or "")
                blocks = [b for b in blocks if not b[2]]
                role, at, slots, own = _roles(host, tags, blocks, {x: np.array(v or [], dtype=np.int64) for x, v in zip(PARTS, found, strict=True)})
                out |= {(host, r, t) for r, t in zip(np.delete(role, at).tolist(), tags, strict=True)}
                for b, s, r in zip(blocks, slots.tolist(), own.tolist(), strict=True):
                    out |= {(host, s, b[0]), (host, r, f"{b[0]}>#{_text_key(b[3])}")}
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*sorted(out), strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string())], names=["host", "role", "token"])

    p = with_parts(pages.select(host_of()(url).alias("host"), F.col(html_col).alias("html"), F.col(key).alias("_k")), "host", parts, _pack(parts), ["_k"])
    names = p.select("host", "html", *PARTS).mapInArrow(run, "host string, role long, token string").join(shown.select("host", "role"), ["host", "role"], "left_semi").groupBy("host", "role").agg(F.min("token").alias("token"))
    return shown.join(names, ["host", "role"]).select("host", "token", "kind", F.col("class").cast("string").alias("class"), "depth", "links", "weight")


def main_text(page: str | None, template: dict, host: str = "") -> str:
    """Main text of a page: blocks joined by an empty line; empty if there is none.

    Blocks are looked up in the slots of the host's template. Excluded ones are out. Under an article or main element all
    others are taken but notices. Without one, those that are no template text, nor in menus.
    """
    tags, blocks = parse(page or "")
    within = any(b[1] for b in blocks)
    # Excluded texts are no tokens, here as in the skeletons.
    blocks = [b for b in blocks if not b[2]]
    if not blocks:
        return ""
    slots, own = (x.tolist() for x in _roles(host, tags, blocks, template)[2:]) if template else ([0] * len(blocks), [0] * len(blocks))
    fixed, notices, menus = (template.get(x, ()) for x in PARTS[2:])
    if within:
        return "\n\n".join(b[3] for b, r in zip(blocks, own, strict=True) if b[1] and r not in notices)
    return "\n\n".join(b[3] for b, s, r in zip(blocks, slots, own, strict=True) if r not in fixed and s not in menus and b[4] < LINK_SHARE * len(b[3]))


def extract(pages: DataFrame, url: str = "url", html_col: str = "html", key: str = "page_id", text_col: str = "text") -> DataFrame:
    """pages with text_col, their main text.

    White space in a block is one space; references are decoded; nothing is cut. Null and empty pages, and pages
    without main text, have the empty text. Rows that repeat get equal texts. Pages whose url has no host share the host of no
    name. Very long pages are read whole, an empty table stays empty, a column named text_col is replaced.

    A host's template is one row; it goes to all tasks, or, beyond BROADCAST_ROWS tokens, to the host's pages
    by a join on host and salt.
    """
    pages = pages.drop(text_col)
    parts = deduce(pages, url, html_col)[1]
    packed = _pack(parts).select("host", *[F.col(x).alias(f"_{x}") for x in PARTS])
    # Columns of pages may have any name, so the host and its template go by names that they don't have.
    d = pages.select(*[F.col(f"`{c}`") for c in pages.columns], host_of()(url).alias("_host"))
    d = with_parts(d, "_host", parts, packed, [url, key]).select(*[F.col(f"`{c}`") for c in pages.columns], "_host", *[f"_{x}" for x in PARTS])
    where, n = pages.columns.index(html_col), len(pages.columns)

    def run(batches):
        for batch in chunks(batches, html_col, 4_000_000):
            known: dict[str, dict] = {}
            out = []
            hosts = batch.column(n).to_pylist()
            for i, page in enumerate(batch.column(where).to_pylist()):
                t = known.get(hosts[i])
                if t is None:
                    found = {x: batch.column(n + 1 + j)[i].as_py() or () for j, x in enumerate(PARTS)}
                    t = known[hosts[i]] = {x: np.array(v, dtype=np.int64) if x in PARTS[:2] else set(v) for x, v in found.items()}
                out.append(main_text(page, t, hosts[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.string())], names=[*batch.schema.names[:n], text_col])

    return d.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(text_col, T.StringType())]))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
