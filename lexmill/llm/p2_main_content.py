"""Problem 2: the main content of web pages.

The token streams of a host's pages are joined and their suffixes sorted (prefix doubling); neighbours that share a
long run show the substrings that stand on many distinct pages. A block that such runs cover is boilerplate, in any
language and wording, unless it is built like a statement, a heading or a `label: value` list: those repeat inside
articles as often as menus do. There, and for blocks that stand on too few pages to be told by repetition, what a block
says decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import BMP, FACTOR, run_digest, table, written
from lexmill.llm.p1_group_splits import page_address

#: A host with more rows or characters is split into shards of about so many, page by page; runs are counted over all of them.
SHARD, SHARD_CHARS = 20_000, 8_000_000
#: More big hosts than this are joined by a shuffle instead of a broadcast.
MAX_BROADCAST = 100_000
#: Least tokens of a run (marks and line ends are tokens), and the distinct pages it must stand on: so many, and this share of its host's.
RUN, PAGES, SHARE_OF_PAGES = 6, 3, 0.002

#: Names of site sections, as menus and path lines have them (fixed values).
SECTIONS = (
    "home", "news", "newsroom", "about", "about us", "contact", "contact us", "search", "archive", "people", "research", "education", "publications",
    "events", "careers", "topics", "help", "maps", "explore", "partners", "facilities", "programs", "programmes", "gallery", "outreach", "data library",
    "field notes", "shop", "blog", "products", "services", "support", "login", "log in", "register", "faq", "press", "jobs", "team", "login", "media", "projects",
)
#: Headings inside articles (fixed values).
HEADINGS = frozenset((
    "summary", "background", "method", "methods", "results", "discussion", "conclusion", "conclusions", "introduction", "abstract", "references", "limits of the data",
    "open questions", "a closer look", "why it matters", "how it works", "what was measured",
))
_SECTION = "|".join(sorted((re.escape(s) for s in SECTIONS), key=len, reverse=True))
_MARKS = r"[\s·•|/>»«‹›→,\-–—:*#()\[\]]*"
MENU = re.compile(rf"(?i){_MARKS}(?:(?:{_SECTION})(?:\s*\(current\))?(?![^\W\d_]){_MARKS})+")
PATH = re.compile(rf"(?i){_MARKS}(?:(?:{_SECTION})(?:\s*\(current\))?\s*[/>»›→|·]\s*)+\S.{{0,120}}")
#: Whole lines that are controls or headings of teasers.
CONTROL = re.compile(r"""(?ix)\W*(?:
    menu | (?:open|close|site)\ search | (?:toggle|main|site)\ (?:navigation|menu) | (?:skip|jump|go)\ to\ (?:the\ )?(?:main\ )?content | (?:back|return)\ to\ (?:the\ )?top
  | most\ (?:read|popular|viewed) | (?:you\ may|you\ might)\ also\ like | more\ on\ this\ (?:topic|subject|story) | more\ like\ this | in\ this\ section
  | related\ (?:links|articles|stories|content|terms|topics) | resources\ and\ related\ terms | latest\ from\ .{1,40} | latest\ news | trending(?:\ now)? | recommended(?:\ for\ you)?
  | read\ (?:more|next) | load\ more | (?:next|previous)(?:\ page|\ article)? | advertisement | sponsored | learn\ more
  )\W*""")
#: Words of notices; a notice also speaks of the reader or the site, which articles on such matters don't.
NOTICE = re.compile(r"(?i)\bcookies?\b|\bprivacy (?:settings|notice|policy)|\bsmall files\b|\bstaying on this (?:page|site)\b")
ADDRESS = re.compile(r"(?i)\b(?:we|our|us|you|your|this site|accept all|agree and|ok, got it)\b")
#: What opens a notice, a control or a line about the page.
OPENS = re.compile(r"""(?ix)\W*(?:
    ©|\(c\)|copyright\b
  | (?:share|tweet|print|e-?mail|post)\b(?=.{0,60}$)(?:\W+\w+)*?\W+(?:mail|e-?mail|pin|link|embed|friend|print|save|facebook|copy)\b | share\ this\b
  | like\ this\?|pass\ it\ on|follow\ (?:us|the\ \w+|.{1,40}\ on\ (?:our|social))
  | (?:sign\ up|subscribe|register)\b | never\ miss\b | support\ .{1,80}\ with\ (?:a|your)\b.{0,30}\b(?:gift|donation)\b | donate\b
  | comments?\s*\(\s*\d+\s*\) | \d+\ comments?\b | leave\ a\ (?:comment|reply)
  | \d+\ (?:min|mins|minutes?)\ read\b | \d+\ views?\b | (?:posted|updated|published)\ (?:on\ )?\d )""")
#: What such a line holds anywhere.
HOLDS = re.compile(r"""(?ix) \ball\ rights\ reserved\b|\bunless\ otherwise\ (?:stated|noted)\b.{0,60}\b(?:privacy|terms|legal)\b
  | \bterms\ of\ use\s*(?:[·|•/–-]|$) | [|·•/]\s*(?:imprint|legal|privacy|terms|accessibility)\W*$ | [/|·]\s*site\ ?map\W*$ | \bcontact\ the\ web\ desk\b
  | \bmailing\ list\b | \bin\ your\ inbox\b | \benter\ your\ e-?mail\b | \b(?:weekly|daily|monthly)\ (?:letter|newsletter)\b
  | \bsign\ in\ to\ (?:reply|comment) | \bfound\ this\ (?:page|article)\ (?:help|use)ful\b | \breading\ time\b""")
#: Titles of other pages.
TEASER = re.compile(r"""(?ix)\W*(?:
    how\ the\ .+\ meets?\ the\ .+ | (?:three|four|five|six|seven|ten|\d+)\ (?:facts|things|reasons|ways|questions)\ (?:about|to|why|on)\ .+ | a\ day\ with\ .+ | (?:video|podcast|gallery|photos|audio)\s*:\ .+
  | what\ an?\ .+\ can\ teach\ us\ about\ .+ | next:\ .+ | see\ also:\ .+ | related\ terms?:\ .+ | downloads?\ for\ .+
  | the\ .+\ season\ opens\ .+,\ and\ visitors\ can\ .+ )""")
LABELLED = re.compile(r"^\W*[^\W\d][^\d:：]{0,40}[:：]\s*\S")
SENTENCE = re.compile(r"[.?!;…。！？；][\"'”’)\]」』）】》]*$")
LINE_BREAK = re.compile(r"\r\n|\r|\n")
#: Without one of these strings HOLDS and NOTICE can't match: most blocks need no more than a walk through their automaton.
TRIGGERS = (
    "rights reserved", "otherwise", "terms", "imprint", "legal", "privacy", "accessibility", "site map", "sitemap", "web desk", "mailing list", "inbox", "enter your e", "letter",
    "sign in to", "found this", "reading time", "cookie", "small files", "staying on",
)
#: Blocks whose reading a worker keeps, at most, and the longest of them; others are read again.
KNOWN, KNOWN_LENGTH = 200_000, 300


class Reader:
    """Reads blocks by themselves: whether one is page furniture by what it says and how it is built."""

    def __init__(self) -> None:
        import ahocorasick

        self.known: dict[str, bool] = {}
        self.triggers = ahocorasick.Automaton()
        for t in TRIGGERS:
            self.triggers.add_word(t, True)
        self.triggers.make_automaton()

    def __call__(self, block: str) -> bool:
        out = self.known.get(block)
        if out is None:
            out = self.reads(block)
            if len(block) <= KNOWN_LENGTH and len(self.known) < KNOWN:
                self.known[block] = out
        return out

    def reads(self, block: str) -> bool:
        line = " ".join(block.split())
        if MENU.fullmatch(line) and not (line.islower() and line.isalpha()) or CONTROL.fullmatch(line) or TEASER.fullmatch(line) or OPENS.match(line):
            return True
        if next(self.triggers.iter(line.lower()), None) and (HOLDS.search(line) or NOTICE.search(line) and ADDRESS.search(line)):
            return True
        return bool(PATH.fullmatch(line))


def is_fragment(line: str) -> bool:
    """The rest of a sentence, not an item of a menu: a single word in lower case or of up to three letters, or what ends in a comma."""
    return line.islower() and line.isalpha() or line[-1:] in ",，、" or " " not in line and sum(map(str.isalpha, line)) <= 3


def is_statement(block: str) -> bool:
    """Whether a block is a sentence, a `label: value` list, a heading inside an article or a rest of one of these."""
    line = block.strip()
    sentence = bool(SENTENCE.search(line)) and (line.count(" ") >= 3 or line[-1] in "。！？；" and len(line) >= 8)
    return line.lower().strip(" .:#*") in HEADINGS or sentence or bool(LABELLED.match(line)) or is_fragment(line)


def blocks(text: str) -> list[str]:
    """The non-blank lines."""
    return [x for x in LINE_BREAK.split(text) if x.strip()]


# --- streams --------------------------------------------------------------------------------------------------------

#: Kinds of characters; code points from BMP on count as letters.
BLANK, LETTER, DIGIT, MARK, BREAK = range(5)
#: Digests of a number (all are equal) and of a line end (fixed odd numbers).
NUMBER, LINE = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC2B2AE3D27D4EB4F)
#: Characters that are handled as arrays at once.
AT_ONCE = 1_000_000


class Streams:
    """Texts as streams of token digests: letters (case ignored), numbers, single marks, a line end before each block and after the last."""

    def __init__(self) -> None:
        kind, low = np.full(BMP, MARK, np.uint8), np.arange(BMP, dtype=np.uint32)
        for o in range(BMP):
            c = chr(o)
            if c.isspace():
                kind[o] = BLANK
            elif c.isdigit():
                kind[o] = DIGIT
            elif c.isalpha():
                kind[o] = LETTER
                if len(c.lower()) == 1:
                    low[o] = ord(c.lower())
        kind[[10, 13]] = BREAK
        self.kind, self.low = kind, low

    def of(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(tokens, length of each text's stream, place of each block's line end, blocks per text, digest of each block)."""
        parts, some, size, at = [], [], 0, 0
        for k, t in enumerate(texts):
            some.append(t)
            size += len(t)
            if size > AT_ONCE or k + 1 == len(texts):
                tokens, length, begin, per_text, line = self._of(some)
                parts.append((tokens, length, begin + at, per_text, line))
                some, size, at = [], 0, at + len(tokens)
        return tuple(map(np.concatenate, zip(*parts)))

    def _of(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        text_end = np.cumsum([len(t) + 1 for t in texts])  # after the line break that was put there
        bmp = np.minimum(code, BMP - 1)
        kind = np.where(code < BMP, self.kind[bmp], LETTER)
        value = np.where(code < BMP, self.low[bmp], code).astype(np.uint64)
        solid = (kind != BLANK) & (kind != BREAK)
        begins = solid & ((kind != np.concatenate([[BLANK], kind[:-1]])) | (kind == MARK))
        inside = np.flatnonzero(solid)
        starts = np.flatnonzero(begins[inside])
        word = run_digest(value[inside], starts, np.append(starts[1:], len(inside)))
        at_char = inside[starts]
        word[kind[at_char] == DIGIT] = NUMBER
        # blocks: lines with a token
        line_no = np.cumsum(kind == BREAK)[at_char]
        new = np.flatnonzero(np.concatenate([[True], line_no[1:] != line_no[:-1]])) if len(line_no) else np.zeros(0, np.int64)
        block_of = np.zeros(len(word), np.int64)
        block_of[new[1:]] = 1
        block_of = np.cumsum(block_of)
        text_of = np.searchsorted(text_end, at_char, side="right")
        line = run_digest(word, new, np.append(new[1:], len(word)))
        per_text = np.bincount(text_of[new], minlength=len(texts))
        stream = np.full(len(word) + len(new) + len(texts), LINE, np.uint64)
        stream[np.arange(len(word)) + block_of + 1 + text_of] = word
        return stream, np.bincount(text_of, minlength=len(texts)) + per_text + 1, new + np.arange(len(new)) + text_of[new], per_text, line


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): the stable order of the keys, and the rank of each; equal keys share one."""
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order].view(np.int64)) != 0]))[: len(key)]
    return order, rank


def _pages_of(order: np.ndarray, rank: np.ndarray, page: np.ndarray) -> np.ndarray:
    """The distinct pages of each rank; in the order equal ranks lie together, and their pages rise."""
    r, p = rank[order], page[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])])[: len(r)]
    return np.bincount(r[new])


def suffix_array(tokens: np.ndarray, stop: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes by their first `depth` tokens, equal ones in the order of their places; prefix doubling.

    stop: where the text of each token ends; no suffix reaches over it.
    """
    n, place = len(tokens), np.arange(len(tokens))
    order, rank = _ranked(tokens)
    have = 1
    while have < depth:
        step = min(have, depth - have)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        after[place + step >= stop] = 0
        order, rank = _ranked(rank * (n + 2) + after)
        have += step
    return order, rank


def runs(tokens: np.ndarray, stop: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, rank, pages): where a run of `run` tokens begins that lies inside its text, the rank of each, the distinct pages of each rank.

    Every substring of at least `run` tokens that stands on some number of pages is the union of its runs of `run`
    tokens, which stand on as many pages at least; and each of these is such a substring itself. So what they cover is
    what all repeated substrings cover, and the suffixes need no order beyond that depth. page must rise.
    """
    starts = np.flatnonzero(np.arange(len(tokens)) + run <= stop)
    if not len(starts):
        return starts, starts, np.zeros(0, np.int64)
    order, rank = suffix_array(tokens, stop, run)
    inside = np.zeros(len(tokens), bool)
    inside[starts] = True
    order = order[inside[order]]
    return starts, rank[starts], _pages_of(order, rank, page)


def covered(n: int, starts: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which of n tokens lie in a run that begins at one of the starts."""
    reach = np.zeros(n + run, np.int64)
    reach[starts] += 1
    reach[starts + run] -= 1
    return np.cumsum(reach)[:n] > 0


def run_digests(tokens: np.ndarray, starts: np.ndarray, run: int = RUN) -> np.ndarray:
    """A 64-bit digest of the run that begins at each of the starts."""
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            out = (out ^ tokens[starts + k]) * FACTOR
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def least_pages(n: int) -> int:
    """The distinct pages of a host of n pages that a run or line must stand on."""
    return max(PAGES, -int(-n * SHARE_OF_PAGES // 1))


class Host:
    """The texts of a host, or of one of its shards, page by page."""

    def __init__(self, streams: Streams, texts: list[str], page: np.ndarray):
        """page: the page of each text, numbered so that it rises."""
        self.tokens, length, self.at, self.per_text, line = streams.of(texts)
        self.line = line.view(np.int64)
        stop = np.cumsum(length)
        self.stop, self.page = np.repeat(stop, length), np.repeat(page, length)
        # of each block, with the line end that closes it: the next block's, or at a text's end its own
        self.end = np.minimum(np.append(self.at[1:], len(self.tokens)) + 1, np.repeat(stop, self.per_text))
        self.block_page = np.repeat(page, self.per_text)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return runs(self.tokens, self.stop, self.page)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(rank of each block, distinct pages of each rank)."""
        order, rank = _ranked(self.line)
        return rank, _pages_of(order, rank, self.block_page)

    def cover(self, starts: np.ndarray) -> np.ndarray:
        """The covered share of each block's tokens, with the line ends on both sides."""
        upto = np.concatenate([[0], np.cumsum(covered(len(self.tokens), starts))])
        return (upto[self.end] - upto[self.at]) / np.maximum(self.end - self.at, 1)


def judge(host: Host, texts: list[str], reader: Reader, many_runs: np.ndarray, many_lines: np.ndarray) -> Iterator[tuple[list[str], list[bool], np.ndarray]]:
    """(blocks, is furniture, covered share) of each text.

    many_runs: where a run begins that stands on many pages; many_lines: whether each block as a whole does. A block
    that does, or that such runs cover wholly, is furniture unless it is built like a statement; a statement is if it
    reads so, as is a block that doesn't repeat.
    """
    share = host.cover(many_runs)
    repeated = many_lines | (share >= 1.0)
    k = 0
    for text, n in zip(texts, host.per_text):
        b = blocks(text)
        yield b, [reader(x) or bool(r) and not is_statement(x) for x, r in zip(b, repeated[k : k + n])], share[k : k + n]
        k += n


def shard_counts(host: Host, wide: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    """(line, digest, page, n): of each run and each block of a shard the distinct pages that lie in it whole (page null), and
    a row for each page that other shards hold parts of.

    wide: whether each page is such a one; names: the pages' names.
    """
    starts, rank, _ = host.runs()
    digest = run_digests(host.tokens, starts)
    parts = []
    for line, d, p in ((False, digest, host.page[starts]), (True, host.line, host.block_page)):
        x = pd.DataFrame({"digest": d, "p": p}).drop_duplicates()
        whole = x[~wide[x["p"]]].groupby("digest").size().rename("n").reset_index().assign(page=pd.NA)
        apart = x[wide[x["p"]]]
        parts += [whole.assign(line=line), pd.DataFrame({"digest": apart["digest"], "page": names[apart["p"]], "n": 1, "line": line})]
    out = pd.concat([x for x in parts if len(x)] or parts[:1])
    return out.astype({"page": "Int64", "n": "Int64"})


FOUND = "row_id long, block_no int"
RESULT = "row_id long, block_no int, furniture boolean, covered double, block string"
MAIN = "row_id long, main string"


def _parts(df: DataFrame, shard: int) -> DataFrame:
    """(host, salt, shards, pages, wide, row_id, page, text): the texts with their host and shard.

    A page lies in one shard, unless it has more rows than a shard should (wide): then its rows are dealt one by one.
    """
    address = page_address(F.col("source_url"))
    host = F.coalesce(F.nullif(F.substring_index(address, "/", 1), F.lit("")), F.concat(F.lit("source "), F.col("source")))
    page = F.coalesce(F.xxhash64(address), F.xxhash64(F.lit("g"), F.col("group_id")), F.xxhash64(F.lit("r"), F.col("row_id")))
    df = df.where(F.col("text").isNotNull()).select(F.col("row_id").cast("long").alias("row_id"), "text", page.alias("page"), F.coalesce(host, F.concat(F.lit("row "), F.col("row_id").cast("string")), F.lit("")).alias("host"))
    each = df.groupBy("host", "page").agg(F.count("*").alias("k"), F.sum(F.length("text")).alias("c"))
    sizes = each.groupBy("host").agg(F.ceil(F.greatest(F.sum("k") / shard, F.sum("c") / SHARD_CHARS)).alias("shards"), F.count("*").alias("pages"))
    big = written(sizes.where("shards > 1"))
    wide = written(each.where((F.col("k") > shard) | (F.col("c") > SHARD_CHARS)).select("host", "page", F.lit(True).alias("wide")))
    small = lambda x: F.broadcast(x) if x.count() <= MAX_BROADCAST else x
    d = df.join(small(big), "host", "left").join(small(wide), ["host", "page"], "left")
    salt = F.pmod(F.when(F.col("wide"), F.xxhash64("row_id", "text")).otherwise(F.xxhash64("page")), F.coalesce("shards", F.lit(1)))
    return d.select("host", salt.alias("salt"), F.coalesce("shards", F.lit(1)).alias("shards"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("wide", F.lit(False)).alias("wide"), "row_id", "page", "text")


def _judged(df: DataFrame, schema: str, shard: int) -> DataFrame:
    """What `schema` asks for: all blocks, those that are furniture, or the main text."""
    kept: dict[str, object] = {}
    columns = [x.split()[0] for x in schema.split(", ")]

    def load(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[str], Host, np.ndarray]:
        if "s" not in kept:
            kept["s"], kept["r"] = Streams(), Reader()
        pdf = pdf.sort_values(["page", "row_id"], kind="stable")
        page, names = pd.factorize(pdf["page"])
        texts = pdf["text"].tolist()
        return pdf, texts, Host(kept["s"], texts, page), np.asarray(names)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, _, host, names = load(pdf)
        out = shard_counts(host, pdf.groupby("page")["wide"].first().to_numpy(bool), names)
        return out.assign(host=pdf["host"].iloc[0], salt=pdf["salt"].iloc[0])[["host", "salt", "line", "digest", "page", "n"]]

    def run(pdf: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=columns)
        pdf, texts, host, names = load(pdf)
        if pdf["shards"].iloc[0] > 1:
            line = many["line"].to_numpy(bool)
            starts = np.flatnonzero(np.arange(len(host.tokens)) + RUN <= host.stop)
            starts = starts[np.isin(run_digests(host.tokens, starts), many["digest"].to_numpy(np.int64)[~line])]
            lines = np.isin(host.line, many["digest"].to_numpy(np.int64)[line])
        else:
            least = least_pages(len(names))
            starts, rank, n_pages = host.runs()
            starts = starts[n_pages[rank] >= least] if len(starts) else starts
            rank, n_pages = host.lines()
            lines = n_pages[rank] >= least if len(rank) else np.zeros(0, bool)
        rows: list[tuple] = []
        for i, (b, flags, share) in zip(pdf["row_id"], judge(host, texts, kept["r"], starts, lines)):
            if schema == MAIN:
                if b:
                    rows.append((i, "\n".join(x for x, f in zip(b, flags) if not f)))
            elif schema == FOUND:
                rows += [(i, k) for k, f in enumerate(flags, 1) if f]
            else:
                rows += [(i, k, f, c, x) for k, (f, c, x) in enumerate(zip(flags, share, b), 1)]
        return pd.DataFrame(rows, columns=columns).astype({"row_id": "Int64"})

    parts = _parts(df, shard)
    found = written(parts.where("shards > 1").groupBy("host", "salt").applyInPandas(count, "host string, salt long, line boolean, digest long, page long, n long"))
    key = ["host", "line", "digest"]
    # of a page that lies in several shards one row counts
    n = found.groupBy(*key, "page").agg(F.when(F.col("page").isNull(), F.sum("n")).otherwise(1).alias("n")).groupBy(*key).agg(F.sum("n").alias("n"))
    pages = parts.where("shards > 1").groupBy("host").agg(F.first("pages").alias("pages"))
    many = n.where(F.col("n") >= PAGES).join(pages, "host").where(F.col("n") >= F.ceil(F.col("pages") * SHARE_OF_PAGES)).select(*key)
    many = found.select("host", "salt", "line", "digest").distinct().join(many, key)
    return parts.groupBy("host", "salt").cogroup(many.groupBy("host", "salt")).applyInPandas(run, schema)


def judged(df: DataFrame, shard: int = SHARD) -> DataFrame:
    """(row_id, block_no, furniture, covered, block) of every block of every text.

    Needs row_id, text, source_url, source, group_id. Blocks are the non-blank lines, numbered from 1; covered is the
    share of its tokens in runs that stand on many pages. Null texts and texts of blanks have no block, null ids pass; a
    row without host or source is judged by itself, repeated rows are rows of one page. A host with more than `shard`
    rows (or very long ones), be it a third of all, is split into shards, and so is a page with a third of all rows;
    runs are counted over all shards, so the result doesn't depend on them.
    """
    return _judged(df, RESULT, shard)


def furniture(df: DataFrame, shard: int = SHARD) -> DataFrame:
    """(row_id, block_no) of the blocks that are not main content."""
    return _judged(df, FOUND, shard)


def main_text(df: DataFrame, shard: int = SHARD) -> DataFrame:
    """(row_id, main): the blocks of main content, joined by line breaks; the empty string where a text has none."""
    return _judged(df, MAIN, shard)


NEEDS = ["row_id", "text", "source_url", "source", "group_id"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture(table(spark, sf_dir, "article_en", *NEEDS))


def p2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "article_en", *NEEDS))
