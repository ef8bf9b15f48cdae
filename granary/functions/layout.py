"""Page layout: sizes, boxes, cells to Markdown, and repair of a model's layout JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as tx

CELL = "array<struct<bbox:array<int>,category:string,text:string>>"


def round_by(x: Column, factor: int) -> Column:
    """The multiple of ``factor`` nearest to x; halves go to the even multiple."""
    return F.bround(x / factor).cast("long") * factor


def ceil_by(x: Column, factor: int) -> Column:
    return F.ceil(x / factor).cast("long") * factor


def floor_by(x: Column, factor: int) -> Column:
    return F.floor(x / factor).cast("long") * factor


def smart_resize(height: Column, width: Column, factor: int = 28, least: int = 3136, most: int = 11_289_600) -> Column:
    """struct<height, width>: multiples of ``factor`` with a pixel count within bounds; null if one side is over 200 times the other."""
    f = F.lit(factor).cast("long")
    h, w = F.greatest(f, round_by(height, factor)), F.greatest(f, round_by(width, factor))
    area = (height * width).cast("double")
    shrink = F.sqrt(area / most)
    grow = F.sqrt(F.lit(float(least)) / area)
    gh, gw = ceil_by(height * grow, factor), ceil_by(width * grow, factor)
    again = F.sqrt((gh * gw).cast("double") / most)
    pair = lambda a, b: F.struct(a.alias("height"), b.alias("width"))
    size = (
        F.when(h * w > most, pair(F.greatest(f, floor_by(height / shrink, factor)), F.greatest(f, floor_by(width / shrink, factor))))
        .when((h * w < least) & (gh * gw > most), pair(F.greatest(f, floor_by(gh / again, factor)), F.greatest(f, floor_by(gw / again, factor))))
        .when(h * w < least, pair(gh, gw))
        .otherwise(pair(h, w))
    )
    return F.when(F.greatest(height, width) / F.least(height, width) <= 200, size)


def scale_box(bbox: Column, scale_x: Column, scale_y: Column) -> Column:
    """Coordinates over their axis's scale, cut to integers towards zero."""
    return F.transform(bbox, lambda v, i: (v / F.when(i % 2 == 0, scale_x).otherwise(scale_y)).cast("int"))


def to_input(bbox: Column, width: Column, height: Column, input_width: Column, input_height: Column) -> Column:
    size = smart_resize(input_height, input_width)
    return scale_box(bbox, width / size["width"], height / size["height"])


def to_original(bbox: Column, width: Column, height: Column, input_width: Column, input_height: Column) -> Column:
    size = smart_resize(input_height, input_width)
    return scale_box(bbox, size["width"] / width, size["height"] / height)


def legal(cells: Column) -> Column:
    return F.forall(cells, lambda c: (c["bbox"][2] > c["bbox"][0]) & (c["bbox"][3] > c["bbox"][1]))


def flipped(bbox: Column, page_height: Column) -> Column:
    """From a top-left to a bottom-left origin."""
    return F.array(bbox[0], page_height - bbox[3], bbox[2], page_height - bbox[1])


def picture_text(bbox: Column, text: Column, least: int = 52_000) -> Column:
    """No text for pictures under ``least`` pixels."""
    return F.when((bbox[2] - bbox[0]) * (bbox[3] - bbox[1]) < least, F.lit("")).otherwise(text)


def data_uri(content: Column) -> Column:
    return F.concat(F.lit("data:image;base64,"), F.base64(content))


def to_markdown(cells: Column, headers: bool = True, image: Column | None = None) -> Column:
    """Cells as Markdown, joined by blank lines: formulas set off, pictures as images, other text cleaned."""
    kept = cells if headers else F.filter(cells, lambda c: ~c["category"].isin("Page-header", "Page-footer"))
    shown = F.lit("") if image is None else data_uri(image)

    def one(c: Column) -> Column:
        text = F.coalesce(c["text"], F.lit(""))
        return F.when(c["category"] == "Picture", F.concat(F.lit("![]("), shown, F.lit(")"))).when(c["category"] == "Formula", tx.formula(text)).otherwise(tx.clean(text))

    return F.array_join(F.transform(kept, one), "\n\n")


def has_equation(spans: Column) -> Column:
    return F.exists(spans, lambda s: s["type"].contains("equation"))


_INNER, _BOX = "[^{}]*?", '"bbox"' + r"\s*:\s*"
OBJECT = r"(?s)\{" + _INNER + _BOX + r"\[[^\]]*?\]" + _INNER + r"\}"


_let = tx.let


def repaired(raw: Column) -> Column:
    """Layout JSON text with missing commas, a cut last element, repeated objects and missing brackets put right."""

    def cut(t: Column) -> Column:
        n = F.size(F.split(t, r'\{"bbox":', -1)) - 1
        head = F.call_function("substring_index", t, F.lit('{"bbox":'), n)
        shorter = F.regexp_replace(F.regexp_replace(head, r"\s+$", ""), ",$", "")
        broken = (F.length(t) > 50_000) | ~F.regexp_replace(t, r"\s+$", "").endswith("]")
        return F.when(broken & (n > 1), shorter).otherwise(t)

    def once(t: Column) -> Column:
        joined = lambda o: F.when(F.size(F.array_distinct(o)) < F.size(o), F.concat(F.lit("["), F.array_join(F.array_distinct(o), ", "), F.lit("]"))).otherwise(t)
        return _let(F.regexp_extract_all(t, F.lit(OBJECT), 0), joined)

    def closed(t: Column) -> Column:
        return F.when(t.endswith("]"), t).otherwise(F.concat(F.regexp_replace(F.regexp_replace(t, ",+$", ""), r"\s+$", ""), F.lit("]")))

    t = F.regexp_replace(raw, r"\}\s*\{" + '(?!")', "},{")
    t = tx.strip(_let(_let(t, cut), once))
    return _let(_let(t, lambda x: F.when(x.startswith("["), x).otherwise(F.concat(F.lit("["), x))), closed)


def _single(t: Column) -> Column:
    """The one cell that can be read from a single object that breaks off."""
    numbers = F.transform(F.split(F.regexp_extract(t, _BOX + r"\[([^\]]+)\]", 1), ","), lambda x: F.trim(x).try_cast("int"))
    category = F.regexp_extract(t, '"category"' + r"\s*:\s*" + '"([^"]+)"', 1)
    text = F.nullif(F.regexp_extract(t, '"text"' + r"\s*:\s*" + '"([^"]{0,10000})', 1), F.lit(""))
    ok = tx.strip(t).startswith('[{"bbox":') & (F.size(numbers) == 4) & F.forall(numbers, lambda x: x.isNotNull())
    cell = F.struct(numbers.alias("bbox"), F.when(category == "", F.lit("Text")).otherwise(category).alias("category"), text.alias("text"))
    return F.when(ok, F.array(cell).cast(CELL))


def parse_cells(raw: Column) -> Column:
    """Cells of a model's layout text after repair; what can't be parsed gives the objects that can, or none."""

    def read(t: Column) -> Column:
        whole = F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, CELL, {"mode": "PERMISSIVE"}))
        each = F.transform(F.regexp_extract_all(t, F.lit(OBJECT), 0), lambda o: F.when(F.try_parse_json(o).isNotNull(), F.from_json(o, CELL[len("array<") : -1])))
        some = _let(F.filter(each, lambda c: c.isNotNull()), lambda e: F.when(F.size(e) > 0, e))
        return F.coalesce(whole, some, _single(t), F.array().cast(CELL))

    return _let(repaired(raw), read)


def usable(cells: Column) -> Column:
    """Cells with four coordinates; three lose the box, other boxes the cell; without a box a category is needed."""

    def fixed(c: Column) -> Column:
        n = F.when(c["bbox"].isNull(), F.lit(-1)).otherwise(F.size(c["bbox"]))
        bare = F.struct(F.lit(None).cast("array<int>").alias("bbox"), c["category"].alias("category"), c["text"].alias("text"))
        return F.when(n == 4, c).when((n == 3) & (c["category"].isNotNull() | c["text"].isNotNull()), bare).when((n == -1) & c["category"].isNotNull(), c)

    return F.filter(F.transform(cells, fixed), lambda c: c.isNotNull())


def without_repeats(cells: Column, pairs: int = 5, boxes: int = 2) -> Column:
    """Only the first of cells whose (category, text) comes ``pairs`` times or more, or whose box comes ``boxes`` times or more.

    Keys are strings in one array each, so that a cell's first place and count are array functions.
    """
    pair = lambda c: F.coalesce(F.concat(c["category"], F.lit("\x00"), c["text"]), F.lit(""))
    box = lambda c: F.coalesce(F.array_join(c["bbox"], ","), F.lit(""))
    held = F.struct(cells.alias("c"), F.transform(cells, pair).alias("p"), F.transform(cells, box).alias("b"))

    def run(h: Column) -> Column:
        late = lambda keys, i, most: (keys[i] != "") & (F.array_position(keys, keys[i]) <= i) & (F.size(F.filter(keys, lambda x: x == keys[i])) >= most)
        marked = F.transform(h["c"], lambda c, i: F.struct(c.alias("c"), (late(h["p"], i, pairs) | late(h["b"], i, boxes)).alias("late")))
        return F.transform(F.filter(marked, lambda m: ~m["late"]), lambda m: m["c"])

    return _let(held, run)


def cleaned(raw: Column) -> Column:
    return without_repeats(parse_cells(raw))


def output_text(raw: Column) -> Column:
    """struct<text, cells, filtered>: parsed cells where the reply is JSON, else the repaired cells' texts."""
    direct = F.when(F.try_parse_json(raw).isNotNull(), F.from_json(raw, CELL, {"mode": "PERMISSIVE"}))
    bad = direct.isNull()
    texts = F.array_join(F.filter(F.transform(cleaned(raw), lambda c: c["text"]), lambda t: t.isNotNull()), "\n\n")
    return F.struct(F.when(bad, texts).alias("text"), direct.alias("cells"), bad.alias("filtered"))


def cleaned_predictions(rows: DataFrame, field: str = "predict", out: str = "predict_resized") -> DataFrame:
    """``rows`` with the cells of the reply in ``field`` (text or cells) put right and freed of repeats, as ``out``."""
    kind = dict(rows.dtypes)[field]
    raw = F.col(field) if kind == "string" else F.to_json(field)
    return rows.withColumn(out, cleaned(raw))


def crop_points(bbox: Column, image_width: Column, image_height: Column, page_width: Column, page_height: Column) -> Column:
    """A box in pixels of a page's image as points of the page."""
    return F.transform(bbox, lambda v, i: v / F.when(i % 2 == 0, image_width / page_width).otherwise(image_height / page_height))
