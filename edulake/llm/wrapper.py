"""Main text of web pages by wrapper induction: what a site repeats is its template, what varies is content.

Three passes over the pages, each in the tasks that hold them. The first counts the block trees of every host and takes
the commonest as the host's template. The second aligns each page with it by simple tree matching and counts, per host
and slot, on how many pages each text stands. Texts that most pages of a host hold in one slot are constant, and slots
that recycle few texts over many pages hold no content either. The third aligns again and joins the varying slots.
Elements that say what they are (menus, footers, adverts, comments) are template on any site, also on one of few pages,
but not where they hold the article or most of a page's varying text.

Only counts cross the network, summed up inside the tasks first; pages stay where they are unless the templates of all
hosts are too large to broadcast, and then a hot host's pages are split over tasks by the skewed join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edulake.llm.dom import Node, Template, parse, skeleton
from edulake.llm.textops import released, whole_text
from edulake.session import settle

#: A text that this share of a host's pages holds in one slot is constant, on a host of at least so many pages.
CONSTANT, LEAST_PAGES = 0.9, 8
#: A slot outside of the article with so many texts of which only this share is distinct recycles them.
RECYCLED, LEAST_TEXTS = 0.1, 50
#: Distinct counters that a task holds before it hands them on.
HELD = 1 << 17


def host_of(url: Column) -> Column:
    """The host of an address in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def text_key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _counted(counts: Counter, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*counts)) or [() for _ in kinds]
    arrays = [pa.array(column, type=kind) for column, kind in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(list(counts.values()), type=pa.int64())], [*names, "n"])


@released
def _skeleton_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["host", "skeleton"], [pa.string(), pa.string()]
    counts: Counter = Counter()
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            counts[host, skeleton(parse(page)[0])] += 1
        if len(counts) > HELD:
            yield _counted(counts, names, kinds)
            counts.clear()
    yield _counted(counts, names, kinds)


class _Templates:
    """Templates by skeleton; a task meets few."""

    def __init__(self):
        self.known: dict[str, Template] = {}

    def __call__(self, text: str) -> Template:
        if text not in self.known:
            if len(self.known) >= 1024:
                self.known.clear()
            self.known[text] = Template(text)
        return self.known[text]


def _aligned(page: str, template: Template) -> list[tuple[Node, str]]:
    root, blocks = parse(page)
    template.align(root)
    return blocks


@released
def _slot_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["host", "slot", "key"], [pa.string(), pa.string(), pa.int64()]
    counts: Counter = Counter()
    templates = _Templates()
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("host", "html", "skeleton")]
        for host, page, shape in zip(*columns):
            # A text counts once for each slot of a page.
            counts.update({(host, node.slot, text_key(text)) for node, text in _aligned(page, templates(shape))})
            if len(counts) > HELD:
                yield _counted(counts, names, kinds)
                counts.clear()
    yield _counted(counts, names, kinds)


def main_text(blocks: list[tuple[Node, str]], constant: set[tuple[str, int]], recycled: set[str]) -> str:
    """The texts of varying slots, one to a line.

    Marked containers are left out, unless no article stands outside of them and they hold most of what varies.
    """
    varying = [
        (node, text)
        for node, text in blocks
        if not node.aside
        and (node.main or node.slot not in recycled)
        and (node.slot, text_key(text)) not in constant
    ]
    plain = [(node, text) for node, text in varying if not node.marked]
    size = sum(len(text) for _, text in plain)
    if any(node.main for node, _ in plain) or 2 * size >= sum(len(text) for _, text in varying):
        varying = plain
    return "\n".join(text for _, text in varying)


def _text_batches(names: list[str]):
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = _Templates()
        for batch in batches:
            own = [batch.column(n).to_pylist() for n in ("html", "skeleton", "constant", "recycled")]
            texts = [
                main_text(
                    _aligned(page, templates(shape)),
                    {(x["slot"], x["key"]) for x in constant or ()},
                    set(recycled or ()),
                )
                for page, shape, constant, recycled in zip(*own)
            ]
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, type=pa.string())], [*names, "text"])

    return run


def wrappers(pages: DataFrame) -> DataFrame:
    """``host``, its ``skeleton``, the ``constant`` texts by slot and the ``recycled`` slots; from ``host``, ``html``."""
    shapes = pages.select("host", "html").mapInArrow(_skeleton_batches, "host string, skeleton string, n bigint")
    shapes = shapes.groupBy("host", "skeleton").agg(F.sum("n").alias("n"))
    best = F.max(F.struct("n", "skeleton")).alias("best")
    hosts = settle(shapes.groupBy("host").agg(best, F.sum("n").alias("pages")))
    hosts = hosts.select("host", "best.skeleton", "pages")
    met = pages.select("host", "html").join(hosts.select("host", "skeleton"), "host")
    slots = met.select("host", "html", "skeleton").mapInArrow(
        _slot_batches, "host string, slot string, key bigint, n bigint"
    )
    slots = settle(slots.groupBy("host", "slot", "key").agg(F.sum("n").alias("n")))
    constant = slots.join(hosts, "host").where(
        (F.col("pages") >= LEAST_PAGES) & (F.col("n") >= F.lit(CONSTANT) * F.col("pages"))
    )
    constant = constant.groupBy("host").agg(F.collect_set(F.struct("slot", "key")).alias("constant"))
    few = slots.groupBy("host", "slot").agg(F.sum("n").alias("texts"), F.count("*").alias("distinct"))
    few = few.where((F.col("texts") >= LEAST_TEXTS) & (F.col("distinct") <= F.lit(RECYCLED) * F.col("texts")))
    few = few.groupBy("host").agg(F.collect_set("slot").alias("recycled"))
    return settle(hosts.select("host", "skeleton").join(constant, "host", "left").join(few, "host", "left"))


def extract(pages: DataFrame, url: str = "url", page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (all but the page without it), then ``text`` and ``n_chars``, its code points.

    Character references are decoded, white space inside a block becomes one space, and blocks are joined by line
    feeds in the order of the page. Nothing is cut. A null page is empty and gives an empty text; a null or odd
    address belongs to the host without a name. Repeated rows each get their row and count as pages of their host.
    """
    names = keep or [c for c in pages.columns if c != page]
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        host_of(F.col(url)).alias("host"),
        whole_text(F.col(page)).alias("html"),
    )
    met = rows.join(wrappers(rows), "host").select("row", "html", "skeleton", "constant", "recycled")
    found = met.mapInArrow(_text_batches(["row"]), f"row {met.schema['row'].dataType.simpleString()}, text string")
    return found.select("row.*", "text", F.char_length("text").cast("bigint").alias("n_chars"))
