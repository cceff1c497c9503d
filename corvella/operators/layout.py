"""Page layout: boxes, containment, captions, masks, stitching of paragraphs, merging of regions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def area(p: str = "") -> Column:
    return (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))


def overlap(a: str, b: str) -> Column:
    """The area that two boxes share (y upwards, x1 < x2, y1 < y2)."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}{hi}"), F.col(f"{b}{hi}")) - F.greatest(F.col(f"{a}{lo}"), F.col(f"{b}{lo}")))
    return side("x1", "x2") * side("y1", "y2")


def inside_one(tables: DataFrame, figures: DataFrame, share: float = 0.8) -> DataFrame:
    """Tables of which one figure of the page holds `share` of the area or more."""
    t = tables.select("doc", "page", F.col("id").alias("t_id"), *(F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")))
    f = figures.select("doc", "page", *(F.col(c).alias(f"f_{c}") for c in ("x1", "y1", "x2", "y2")))
    held = overlap("t_", "f_") >= share * area("t_")
    return t.join(f, ["doc", "page"]).where(held & (area("t_") > 0)).select(F.col("t_id").alias("id")).distinct()


def duplicates(boxes: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Boxes that an earlier one of the page covers by `ratio` of the smaller area."""
    side = lambda x: boxes.select("doc", "page", F.col("id").alias(f"{x}_id"), *(F.col(c).alias(f"{x}_{c}") for c in ("x1", "y1", "x2", "y2")))
    pairs = side("a").join(side("b"), ["doc", "page"]).where("a_id < b_id")
    return pairs.where(overlap("a_", "b_") > ratio * F.least(area("a_"), area("b_"))).select(F.col("b_id").alias("id")).distinct()


def nearest_caption(media: DataFrame, captions: DataFrame) -> DataFrame:
    """For each medium the caption of its page whose edge is nearest (top to bottom or bottom to top), the smaller id of equals.

    Edges of a page stand in one order, so a medium looks at its neighbours in it and not at every caption.
    """

    def along(m_edge: str, c_edge: str) -> DataFrame:
        own = captions.groupBy("doc", "page", F.col(c_edge).alias("at")).agg(F.min("id").alias("c_id")).withColumn("m_id", F.lit(None).cast("long"))
        line = media.select("doc", "page", F.col(m_edge).alias("at"), F.lit(None).cast("long").alias("c_id"), F.col("id").cast("long").alias("m_id")).unionByName(own)
        w = Window.partitionBy("doc", "page").orderBy("at")
        here = F.when(F.col("c_id").isNotNull(), F.struct("at", "c_id"))
        below, above = F.last(here, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.first(here, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
        near = line.withColumn("_b", below).withColumn("_a", above).where("m_id IS NOT NULL")
        gap = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{x}.at")).alias("distance"), F.col(f"{x}.c_id").alias("c_id")))
        return near.select("m_id", F.explode(F.array_compact(F.array(gap("_b"), gap("_a")))).alias("n"))

    best = along("y1", "y2").union(along("y2", "y1")).groupBy("m_id").agg(F.min("n").alias("n"))
    return best.select("m_id", "n.c_id", "n.distance")


def anchor_bounds(elements: DataFrame, least_height: float = 15.0) -> DataFrame:
    """The top and bottom of each page's tall elements."""
    return elements.where((F.col("y2") - F.col("y1")) >= least_height).groupBy("doc", "page").agg(F.max("y2").alias("top"), F.min("y1").alias("bottom"))


#: How lines of article metadata at a page's side begin (fixed values).
METADATA = r"(?i)^(Received|Revised|Accepted|Published|Citation|Academic\s+Editor|Handling\s+Editor|Copyright|Licensee)\s*[:\s]"


def artifacts(elements: DataFrame, least_height: float = 15.0) -> DataFrame:
    """Elements that aren't content: without letters A to Z, lines of metadata, and low TEXT elements that reach beyond the page's tall elements.

    Columns: id, doc, page, type, text, y1, y2. Pages without tall elements keep their low ones (no language model judges them).
    """
    e = elements.join(anchor_bounds(elements, least_height), ["doc", "page"], "left")
    text = F.trim(F.coalesce("text", F.lit("")))
    beyond = (F.col("type") == "TEXT") & (F.col("y2") - F.col("y1") < least_height) & ((F.col("y2") > F.col("top")) | (F.col("y1") < F.col("bottom")))
    return e.where(~text.rlike("[a-zA-Z]") | text.rlike(METADATA) | F.coalesce(beyond, F.lit(False))).select("id")


#: Types of text nodes that are judged by evidence; all others are kept (fixed values).
JUDGED = ("TEXT", "LIST_ITEM", "PARAGRAPH")


def node_score(most_white: float = 1.0, most_dense: float = 15.0, least_coverage: float = 0.05, least_chars: int = 8) -> Column:
    """Why a text node is taken for a hidden layer (null: it is kept), by the first rule that fits.

    Columns: type, text, y1, y2; of the evidence white (share of near-white characters), rendered, blank, n_words and coverage.
    R0: no text. R-color: too many white characters (off at a share of 1). R3: too many characters for the height of the box.
    R1: rendered and blank. R2: not rendered, no words in the box, hardly covered, and long enough to tell.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    height = F.abs(F.col("y1") - F.col("y2"))
    rule = (
        F.when(text == "", "R0").when(F.lit(most_white < 1.0) & (F.col("white") > most_white), "R-color")
        .when(F.lit(most_dense > 0) & (height > 0) & (F.length(text) / height > most_dense), "R3").when(F.col("rendered") & F.col("blank"), "R1")
        .when(~F.col("rendered") & (F.col("n_words") == 0) & (F.col("coverage") < least_coverage) & (F.length(text) >= least_chars), "R2")
    )
    return F.when(F.col("type").isin(*JUDGED), rule)


def in_header_zone(page_height: Column, share: float = 0.15) -> Column:
    """Whether an element's top edge lies in the uppermost `share` of the page (y upwards): a hint in reasons."""
    return (page_height > 0) & ((page_height - F.greatest("y1", "y2")) / page_height <= share)


def masks(elements: DataFrame, pages: DataFrame, gap: float = 50.0, widest: float = 150.0, least_height: float = 15.0) -> DataFrame:
    """Regions to mask (doc, page, kind, x1, y1, x2, y2): sidebar elements with text, and on each page with tall elements the
    strips above and below them (header, footer).

    The columns of a document are told by gaps wider than `gap` between left edges of its tall elements: narrow elements
    that end left of the first gap's end, or with two gaps or more begin right of the last one's beginning, are sidebars.
    """
    tall = F.col("y2") - F.col("y1") >= least_height
    w = Window.partitionBy("doc").orderBy("x1", "id")  # a document's elements
    gaps = elements.where(tall).withColumn("_next", F.lead("x1").over(w)).where(F.col("_next") - F.col("x1") > gap)
    bounds = gaps.groupBy("doc").agg(F.min(F.struct("x1", "id", "_next"))["_next"].alias("_main"), F.when(F.count("*") > 1, F.max("x1")).alias("_right"))
    side = (F.col("x2") - F.col("x1") < widest) & (F.coalesce(F.col("x2") < F.col("_main"), F.lit(False)) | F.coalesce(F.col("x1") > F.col("_right"), F.lit(False)))
    e = elements.join(bounds, "doc", "left").withColumn("_side", side)
    box = ["x1", "y1", "x2", "y2"]
    sidebars = e.where(F.col("_side") & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("doc", "page", F.lit("sidebar").alias("kind"), *box)
    inner = anchor_bounds(e.where(~F.col("_side")), least_height).join(pages, ["doc", "page"], "left").withColumn("_w", F.coalesce("width", F.lit(595.0))).withColumn("_h", F.coalesce("height", F.lit(842.0)))
    strip = lambda kind, low, high: inner.where(high > low).select("doc", "page", F.lit(kind).alias("kind"), F.lit(0.0).alias("x1"), low.alias("y1"), F.col("_w").alias("x2"), high.alias("y2"))
    return sidebars.union(strip("header", F.col("top"), F.col("_h"))).union(strip("footer", F.lit(0.0), F.col("bottom")))


def with_footnotes(elements: DataFrame, first_gap: float = 20.0, growth: float = 1.2, text_gap: float = 8.0) -> DataFrame:
    """Tables grown by the footnotes next to them: (doc, page, id, x1, y1, x2, y2, absorbed).

    Columns: doc, page, id, type, rotated, and the box (y upwards). Tables go by id; an upright one grows downwards, a rotated one
    to the left and then to the right over what overlaps it in height. The nearest TEXT, LIST_ITEM or FOOTNOTE that no table has
    taken joins if its gap is at most `first_gap` - after a first one that isn't TEXT, `growth` times that one's gap - or for TEXT `text_gap`;
    the first that is too far ends it.
    """

    def grow(table: dict, near: list[dict], taken: set, gap_of, join) -> int:
        limit, fixed, n = first_gap, False, 0
        for e in near:
            if e["id"] in taken:
                continue
            gap = gap_of(e)
            if not 0 <= gap <= (text_gap if e["type"] == "TEXT" else limit):
                break
            join(e)
            taken.add(e["id"])
            n += 1
            if not fixed and e["type"] != "TEXT":
                limit, fixed = gap * growth, True
        return n

    def one(page: pd.DataFrame) -> pd.DataFrame:
        rows = page.sort_values("id").to_dict("records")
        notes, taken, out = [r for r in rows if r["type"] in ("TEXT", "LIST_ITEM", "FOOTNOTE")], set(), []
        for t in (r for r in rows if r["type"] == "TABLE"):
            def widen(e, t=t):
                t["x1"], t["x2"], t["y1"], t["y2"] = min(t["x1"], e["x1"]), max(t["x2"], e["x2"]), min(t["y1"], e["y1"]), max(t["y2"], e["y2"])

            if t["rotated"]:
                level = lambda e, t=t: e["y1"] < t["y2"] and t["y1"] < e["y2"]
                left = sorted((e for e in notes if e["x2"] <= t["x1"] and level(e)), key=lambda e: -e["x2"])
                n = grow(t, left, taken, lambda e, t=t: t["x1"] - e["x2"], widen)
                right = sorted((e for e in notes if e["x1"] >= t["x2"] and level(e)), key=lambda e: e["x1"])
                n += grow(t, right, taken, lambda e, t=t: e["x1"] - t["x2"], widen)
            else:
                def lower(e, t=t):
                    t["x1"], t["x2"], t["y1"] = min(t["x1"], e["x1"]), max(t["x2"], e["x2"]), min(t["y1"], e["y1"])

                below = sorted((e for e in notes if e["y2"] < t["y1"]), key=lambda e: -e["y2"])
                n = grow(t, below, taken, lambda e, t=t: t["y1"] - e["y2"], lower)
            out.append((t["doc"], t["page"], t["id"], t["x1"], t["y1"], t["x2"], t["y2"], n))
        return pd.DataFrame(out, columns=["doc", "page", "id", "x1", "y1", "x2", "y2", "absorbed"])

    # elements join tables of their own page alone, so pages are worked on apart
    return elements.groupBy("doc", "page").applyInPandas(one, "doc long, page long, id long, x1 double, y1 double, x2 double, y2 double, absorbed long")


def captioned_figures(elements: DataFrame, least_size: float = 50.0, near: float | None = None) -> DataFrame:
    """Figures with the captions they claim: (doc, num, figure_id, caption, page, x1, y1, x2, y2).

    Columns: doc, page, id, type, text, and the box (y upwards). Figures go by id; too small ones are left out. One takes the nearest
    caption of its page that none has claimed; the number in it (Figure 3) names it, else its place, with b's added while that name is
    taken. With `near`, a figure whose nearest caption of all is claimed already and that is within `near` of its owner is a panel
    of that figure, and united with it; claimed captions are out of sight otherwise.
    """
    import re

    number = re.compile(r"^\s*fig(?:ure)?\.?\s*(\d+)", re.IGNORECASE)

    def edge_distance(f: dict, c: dict) -> float:
        return min(abs(f["y1"] - c["y2"]), abs(c["y1"] - f["y2"]))

    def apart(a: dict, b: dict) -> float:
        return max(0.0, b["y1"] - a["y2"], a["y1"] - b["y2"], max(a["x1"], b["x1"]) - min(a["x2"], b["x2"]))

    def one(doc: pd.DataFrame) -> pd.DataFrame:
        rows = doc.sort_values("id").to_dict("records")
        captions = [r for r in rows if r["type"] == "CAPTION"]
        owner: dict[int, str] = {}
        figures: dict[str, dict] = {}
        for f in rows:
            if f["type"] not in ("PICTURE", "FIGURE") or f["x2"] - f["x1"] < least_size or f["y2"] - f["y1"] < least_size:
                continue
            on_page = [c for c in captions if c["page"] == f["page"]]
            free = [c for c in on_page if c["id"] not in owner]
            best = min(free, key=lambda c: (edge_distance(f, c), c["id"]), default=None)
            closest = min(on_page, key=lambda c: (edge_distance(f, c), c["id"]), default=None)
            if near is not None and closest is not None and closest["id"] in owner:
                o = figures[owner[closest["id"]]]
                if apart(f, o) <= near:
                    o["x1"], o["y1"], o["x2"], o["y2"] = min(o["x1"], f["x1"]), min(o["y1"], f["y1"]), max(o["x2"], f["x2"]), max(o["y2"], f["y2"])
                    continue
            found = number.match(best["text"] or "") if best else None
            num = found[1] if found else str(len(figures) + 1)
            while num in figures:
                num += "b"
            figures[num] = {**f, "caption": best["text"] if best else None, "figure_id": found[1] if found else num}
            if best:
                owner[best["id"]] = num
        columns = ["doc", "num", "figure_id", "caption", "page", "x1", "y1", "x2", "y2"]
        return pd.DataFrame([[f["doc"], n, *(f[c] for c in columns[2:])] for n, f in figures.items()], columns=columns)

    return elements.groupBy("doc").applyInPandas(one, "doc long, num string, figure_id string, caption string, page long, x1 double, y1 double, x2 double, y2 double")


def merge_boxes(boxes: DataFrame) -> DataFrame:
    """Unite boxes of a page that touch, and the unions, until none do; a page's boxes are few."""

    def one(page: pd.DataFrame) -> pd.DataFrame:
        boxes_ = [tuple(r) for r in page.sort_values("id")[["x1", "y1", "x2", "y2"]].to_numpy().tolist()]
        changed = True
        while changed:
            changed, out = False, []
            for b in boxes_:
                for i, o in enumerate(out):
                    if b[0] <= o[2] and o[0] <= b[2] and b[1] <= o[3] and o[1] <= b[3]:
                        out[i] = (min(b[0], o[0]), min(b[1], o[1]), max(b[2], o[2]), max(b[3], o[3]))
                        changed = True
                        break
                else:
                    out.append(b)
            boxes_ = out
        rows = sorted(boxes_)
        return pd.DataFrame({"doc": page["doc"].iloc[0], "page": page["page"].iloc[0], "x1": [r[0] for r in rows], "y1": [r[1] for r in rows], "x2": [r[2] for r in rows], "y2": [r[3] for r in rows]})

    return boxes.groupBy("doc", "page").applyInPandas(one, "doc long, page long, x1 double, y1 double, x2 double, y2 double")


def stitch(paragraphs: DataFrame, lossless: bool = True) -> DataFrame:
    """Join a paragraph that is cut off with the next narrative one of its document (doc, pos, text, kind, cut).

    A chain of cut paragraphs becomes one if `lossless`; otherwise each takes just its successor, and what was taken and
    takes in turn is not given out itself. Blank paragraphs add nothing to a chain.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    other = paragraphs.where("kind <> 'narrative'").select("doc", "pos", "text")
    n = paragraphs.where("kind = 'narrative'").withColumn("_taken", F.coalesce(F.lag("cut").over(w), F.lit(False)))
    left, right = (lambda x: F.regexp_replace(x, r"^\s+", "")), (lambda x: F.regexp_replace(x, r"\s+$", ""))
    if not lossless:
        nxt = F.lead("text").over(w)
        whole = F.when(F.col("cut") & nxt.isNotNull(), F.concat(right(F.col("text")), F.lit(" "), left(nxt))).otherwise(F.col("text"))
        return n.withColumn("text", whole).where("NOT _taken").select("doc", "pos", "text").union(other)
    chains = n.withColumn("_chain", F.sum(F.when(F.col("_taken"), 0).otherwise(1)).over(w)).groupBy("doc", "_chain").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_t"))
    last = F.size("_t") - 1
    trimmed = F.transform("_t", lambda x, i: F.when(i == 0, F.when(last == 0, x["text"]).otherwise(right(x["text"]))).when(i == last, left(x["text"])).otherwise(right(left(x["text"]))))
    return chains.select("doc", "pos", F.array_join(F.when(last == 0, trimmed).otherwise(F.filter(trimmed, lambda x: F.trim(x) != "")), " ").alias("text")).union(other)


def expand_rows(rows: DataFrame, gap: float) -> DataFrame:
    """Rebuild tables from rows below a caption (doc, page, y, kind): rows go on while gaps stay within 1.5 times the mean so far or `gap`."""

    def one(page: pd.DataFrame) -> pd.DataFrame:
        out, table, n, top, last = [], 0, 0, 0.0, 0.0  # n rows of the table so far, its caption among them
        for r in page.sort_values(["y", "kind"], ascending=[False, True]).to_dict("records"):  # a caption before rows of its height
            if r["kind"] == "caption":
                table, n, top, last = table + 1, 1, r["y"], r["y"]
            elif n:
                if last - r["y"] <= max(gap, 1.5 * (top - last) / (n - 1) if n > 1 else 0):
                    n, last = n + 1, r["y"]
                    out.append((r["doc"], r["page"], table, r["y"]))
                else:
                    n = 0
        return pd.DataFrame(out, columns=["doc", "page", "table", "y"])

    return rows.groupBy("doc", "page").applyInPandas(one, "doc long, page long, table long, y double")
