"""Line deduplication by an edit-distance join on segments, in DataFrame functions only.

Lines that are equal are folded first, by a 128-bit hash, and stand in the join
as one.  The edits allowed grow with the length of the shorter of two lines.  A
distinct line is cut into one segment more than that; two lines within reach share
at least one of them, at a place that the edits before
and after it can account for.  So each line files its segments under (length,
segment number, text) and probes, for its own and each smaller length in reach,
the few substrings that could be such a segment.  Where lines meet, what is left
of them is cut and probed in the same way, and again for as long as many meet, so
that lines of one template part at the place where they differ.  Candidates are
verified by a banded edit distance that keeps, for each number of edits, the
diagonals reached as bits of one long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.runtime import cut, ready, small, unused

#: Candidate lines whose texts may be fetched by a broadcast of their places; more are fetched by a shuffle join.
BROADCAST_ROWS = 100_000
#: Lines under one key whose pairs are listed; what is left of more is cut again.
FEW = 16
#: Edits allowed by the length, in characters, of the shorter of two lines.
Classes = tuple[tuple[int, int], ...]
EDITS: Classes = ((0, 1),)


def edit_classes(max_edits: int | Classes) -> Classes:
    """``max_edits`` as pairs (least length, edits), by length; a number holds for lines of any length."""
    return ((0, max_edits),) if isinstance(max_edits, int) else tuple(sorted(max_edits))


def segment_keys(line: str, length: str, max_edits: int | Classes) -> Column:
    """Array of longs: the keys under which a line is filed or looks for others, with a last bit that says which.

    ``line`` and ``length`` name the columns of the text and its length in
    characters.  How many edits are allowed depends on the shorter of two lines,
    which is the one that is filed.
    """
    classes, out = edit_classes(max_edits), []
    for (least, edits), (below, _) in zip(classes, (*classes[1:], (1 << 31, 0)), strict=True):
        for shorter in range(edits + 1):
            keys = ", ".join(f"shiftleft({key}, 1) | {int(filed)}L" for key, filed, _ in _segments(line, length, edits, shorter))
            out.append(f"if({length} - {shorter} >= {least} and {length} - {shorter} < {below}, array({keys}), cast(array() as array<bigint>))")
    return F.expr(f"concat({', '.join(out)})")


def _rests(line: str, length: str, max_edits: int | Classes, inside: bool) -> Column:
    """The same keys as structs, with what is ``rest`` of the line without the segment, the ``edits`` allowed and by how much the lines looked for are ``shorter``.

    ``inside`` what is left of a line, the columns ``edits`` and ``shorter`` say
    what the whole line looks for.
    """
    classes, out = edit_classes(max_edits), []
    for (least, edits), (below, _) in zip(classes, (*classes[1:], (1 << 31, 0)), strict=True):
        for shorter in range(edits + 1):
            here = f"edits = {edits} and shorter = {shorter}" if inside else f"{length} - {shorter} >= {least} and {length} - {shorter} < {below}"
            found = [f"named_struct('key', {key}, 'filed', {str(filed).lower()}, 'edits', {edits}, 'shorter', {shorter}, 'rest', {rest})" for key, filed, rest in _segments(line, length, edits, shorter)]
            out.append(f"if({here}, array({', '.join(found)}), cast(array() as array<struct<key: bigint, filed: boolean, edits: int, shorter: int, rest: string>>))")
    return F.expr(f"concat({', '.join(out)})")


def _segments(line: str, length: str, edits: int, shorter: int) -> list[tuple[str, bool, str]]:
    """SQL of the key, whether the line is filed under it, and SQL of the rest, for lines ``shorter`` by so much."""
    parts, out = edits + 1, []
    size = f"({length} - {shorter})"
    base, over = f"({size} div {parts})", f"({size} % {parts})"
    for i in range(1, parts + 1):
        at = f"(1 + {i - 1} * {base} + greatest(0, {i - 1} - ({parts} - {over})))"
        span = f"({base} + if({i} > {parts} - {over}, 1, 0))"
        first, last = max(1 - i, shorter - (parts - i)), min(i - 1, shorter + (parts - i))
        for off in range(first, last + 1):
            key = f"shiftright(xxhash64({size}, {i}, substring({line}, {at} + {off}, {span})), 1)"
            rest = f"concat(substring({line}, 1, {at} + {off} - 1), substring({line}, {at} + {off} + {span}))"
            out.append((key, shorter == 0 and off == 0, rest))
    return out


def within_edits(a: str, b: str, max_edits: int) -> Column:
    """Whether two string columns are at most ``max_edits`` insertions, deletions and replacements apart.

    For each number of edits up to the limit, bit ``d`` says that the diagonal
    ``d - max_edits`` has been reached with no more than that many edits after the
    characters of ``b`` read so far; all diagonals advance at once.  What both
    begin and end with is taken off first, by halving steps.
    """
    k, width = max_edits, 2 * max_edits + 1
    field = (1 << width) - 1
    sides = f"array(named_struct('a', encode({a}, 'UTF-32'), 'b', encode({b}, 'UTF-32')))"
    shorter, hop = "least(length(s.a), length(s.b))", "shiftleft(1, e)"

    def shared(piece: str) -> str:
        steps = f"sequence(1 + cast(log2(greatest(1, {shorter} div 4)) as int), 0, -1)"
        same = f"{piece.format('s.a')} = {piece.format('s.b')}"
        return f"aggregate({steps}, 0, (p, e) -> if(4 * (p + {hop}) <= {shorter} and {same}, p + {hop}, p))"

    head, tail = shared(f"substring({{0}}, 4 * p + 1, 4 * {hop})"), shared(f"substring({{0}}, length({{0}}) - 4 * (p + {hop}) + 1, 4 * {hop})")
    for n, left in ((head, "substring(s.{0}, 4 * s.n + 1, length(s.{0}))"), (tail, "substring(s.{0}, 1, length(s.{0}) - 4 * s.n)")):
        sides = f"transform({sides}, s -> named_struct('a', s.a, 'b', s.b, 'n', {n}))"
        sides = f"transform({sides}, s -> named_struct('a', {left.format('a')}, 'b', {left.format('b')}))"
    start = sum(sum(1 << (d + k) for d in range(e + 1)) << (width * e) for e in range(k + 1))

    def letter(side: str, at: str) -> str:
        return f"substring(s.{side}, 4 * ({at}) - 3, 4)"

    match = " | ".join(f"if(j + ({d}) >= 1 and {letter('a', f'j + ({d})')} = {letter('b', 'j')}, {1 << (d + k)}L, 0L)" for d in range(-k, k + 1))
    # level e of the next state, from the state r and the matches m
    levels: list[str] = []
    step = "named_struct('m', x.m, 'r', x.r, 'n', 0L)"
    for e in range(k + 1):
        old, below = f"(shiftright(x.r, {width * e}) & {field}L)", f"(shiftright(x.r, {width * (e - 1)}) & {field}L)"
        fresh = f"(shiftright(x.n, {width * (e - 1)}) & {field}L)"
        new = f"({old} & x.m)" if e == 0 else f"(({old} & x.m) | {below} | shiftright({below}, 1) | (shiftleft({fresh}, 1) & {field}L))"
        levels.append(f"named_struct('m', x.m, 'r', x.r, 'n', x.n | shiftleft({new}, {width * e}))")
    chain = f"named_struct('m', {match}, 'r', r, 'n', 0L)"
    for level in levels:  # each level reads the one below it, so they are applied one after the other
        chain = f"aggregate(array({chain}), {step.replace('x.m', '0L').replace('x.r', '0L')}, (z, x) -> {level})"
    walk = f"aggregate(sequence(1, cast(length(s.b) div 4 as int)), {start}L, (r, j) -> {chain}.n)"
    reached = f"shiftright(if(length(s.b) = 0, {start}L, {walk}), cast({width * k} + {k} + (length(s.a) - length(s.b)) div 4 as int)) & 1L"
    near = f"aggregate({sides}, false, (z, s) -> abs(length(s.a) - length(s.b)) <= {4 * k} and ({reached}) = 1L)"
    return F.expr(near)


def _within(a: str, b: str, max_edits: int | Classes) -> Column:
    """``within_edits`` for as many edits as the column ``edits`` says."""
    near = F.lit(False)
    for edits in sorted({k for _, k in edit_classes(max_edits)}):
        near = F.when(F.col("edits") == edits, within_edits(a, b, edits)).otherwise(near)
    return near


def _places(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.posexplode(F.split(F.col(f"`{text_col}`").cast("string"), "\n", -1)).alias("line_no", "line"))
    return rows.where((F.length("line") >= min_chars) & F.col("doc").isNotNull()).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line"), "size": F.length("line")})


def near_lines(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, max_edits: int | Classes, few: int = FEW) -> DataFrame:
    """Classes of equal lines (``first``: place of the first copy) that have an earlier line within reach.

    Keys with a single tenant go first, and the texts of the other keys' tenants
    are fetched.  What is left of two lines without the segment they share must
    again be within ``max_edits``, so it is cut into segments in turn: lines are
    paired only if they agree in both.  Where more than ``few`` still agree, as
    lines of one template do, the cutting goes on; the rest shrinks each time.
    """
    filed = classes.select("first", F.explode("keys").alias("k")).select("first", F.shiftright("k", 1).alias("key"), (F.col("k").bitwiseAND(1) == 1).alias("filed"))
    shared = filed.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("filed").alias("any_filed")).where("n > 1 and any_filed")
    shared = cut(shared.select("key"))
    tenants = cut(filed.join(small(shared, BROADCAST_ROWS), "key", "left_semi").select("first").distinct())
    wanted = tenants.groupBy(F.col("first.doc").alias("doc")).agg(F.collect_list("first").alias("places"))
    if tenants.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    found = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).join(wanted, "doc")
    found = found.select(F.split("text", "\n", -1).alias("lines"), F.explode("places").alias("place")).select("place", F.expr("get(lines, place.line_no)").alias("line"))
    texts = found.where(F.xxhash64("line") == F.col("place.h1")).dropDuplicates(["place"]).withColumn("size", F.length("line"))
    rows = texts.select("place", "line", F.explode(_rests("line", "size", max_edits, inside=False)).alias("k")).select("place", "line", "k.*")
    rows = rows.join(small(shared, BROADCAST_ROWS), "key", "left_semi")
    hits = None
    while True:
        rows = cut(_cut_again(rows, max_edits))
        groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("edits").alias("allowed"), F.max("left").alias("widest"), F.max(F.when(F.col("filed"), F.col("left"))).alias("filed_left"))
        groups = cut(groups.where("n > 1 and filed_left is not null"))
        alike = F.col("widest") <= F.col("allowed")  # any two such rests are within reach
        listed = ~alike & ((F.col("n") <= few) | (F.col("filed_left") <= F.col("allowed")))  # so short, filed rests are few: each has its own text
        found = _listed(_under(rows, groups.where(listed)), max_edits).union(_alike(_under(rows, groups.where(alike)), max_edits))
        hits = found if hits is None else hits.union(found)
        crowded = groups.where(~alike & ~listed)
        if not crowded.head(1):
            return hits.distinct()
        rows = _under(rows, crowded)


def _under(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(small(groups.select("key"), BROADCAST_ROWS), "key", "left_semi")


def _cut_again(rows: DataFrame, max_edits: int | Classes) -> DataFrame:
    """Rows for the segments of what is left of each row's line; a row goes on looking for lines as much shorter as before."""
    parts = rows.withColumn("rest_size", F.length("rest"))
    parts = parts.select("place", "line", "key", "filed", F.explode(_rests("rest", "rest_size", max_edits, inside=True)).alias("k"))
    return parts.select("place", "line", F.xxhash64("key", "k.key").alias("key"), (F.col("filed") & F.col("k.filed")).alias("filed"), "k.edits", "k.shorter", "k.rest", F.length("k.rest").alias("left"))


def _listed(rows: DataFrame, max_edits: int | Classes) -> DataFrame:
    """The later place of each pair within reach, of all pairs of a filed line and another one under a key."""
    mine = rows.where("filed").select("key", "edits", F.col("place").alias("a"), F.col("line").alias("line_a"))
    pairs = mine.join(rows.select("key", "filed", F.col("place").alias("b"), F.col("line").alias("line_b")), "key").where("a < b or (a > b and not filed)")
    return pairs.where(_within("line_a", "line_b", max_edits)).select(F.greatest("a", "b").alias("first"))


def _alike(rows: DataFrame, max_edits: int | Classes) -> DataFrame:
    """The places behind the first one, under keys where every filed line is within reach of every other one."""
    head = F.min(F.struct("place", "line"))
    heads = rows.groupBy("key").agg(head.alias("first_any"), F.min(F.when(F.col("filed"), F.struct("place", "line"))).alias("first_filed"))
    before = rows.join(heads, "key").withColumn("head", F.when(F.col("filed"), F.col("first_any")).otherwise(F.col("first_filed")))
    before = before.where("head.place < place").select("place", "line", "edits", F.col("head.line").alias("head_line"))
    return before.where(_within("line", "head_line", max_edits)).select(F.col("place").alias("first"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int | Classes = EDITS, min_chars: int = 20, few: int = FEW) -> DataFrame:
    """Takes repeated and nearly repeated lines out of texts.

    Lines come in the order of the document's id, then of their place in it.  A
    line of ``min_chars`` characters or more is dropped if an equal line, or one
    within ``max_edits`` edits whose own first copy comes earlier, precedes it;
    shorter lines and the order of the rest stay.  ``max_edits`` is a number, or
    pairs (least length, edits), of which the shorter of two lines takes the last
    that it reaches.  Returns the rows of ``docs`` with the text changed, and
    ``n_lines`` and ``n_dropped`` (columns of these names are replaced, all others
    stay as they are).

    Null texts stay null with zero lines; empty texts have one empty line and
    stay; rows with a null id are left alone.  Rows with the same id count as one
    document, so a repeated row keeps what its twin keeps.  A text may lose all
    its lines and is then empty.
    """
    if any(max(least, min_chars) <= edits for least, edits in edit_classes(max_edits)):
        raise ValueError("lines must be longer than the number of edits")
    ready(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*[F.col(f"`{c}`") for c in rest])
    lines = _places(docs, id_col, text_col, min_chars)
    place = F.struct("doc", "line_no", "h1")
    classes = lines.select("h1", "h2", place.alias("place"), segment_keys("line", "size", max_edits).alias("keys"))
    classes = cut(classes.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.first("keys").alias("keys"), F.count("*").alias("copies")))
    near = near_lines(docs, classes.select("first", "keys"), id_col, text_col, max_edits, few).withColumn("near", F.lit(True))
    hit = classes.drop("keys").join(near, "first", "left").where("copies > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    hit = cut(hit)
    gone = lines.select("h1", "h2", place.alias("place")).join(hit, ["h1", "h2"]).where("near or (place.doc, place.line_no) <> (first.doc, first.line_no)")
    key, lost, held, left = unused(rest, "key", "lost", "held", "left")
    gone = gone.groupBy(F.col("place.doc").alias(key)).agg(F.collect_set(F.struct("place.line_no", "place.h1")).alias(lost))
    text = F.col(f"`{text_col}`").cast("string")
    out = docs.join(gone, F.col(f"`{id_col}`") == F.col(key), "left").withColumn(held, F.split(text, "\n", -1))
    # places are numbers, which array_except tells apart by hash; a twin's other text has other lines there
    places = f"transform(filter({lost}, g -> xxhash64(get({held}, g.line_no)) = g.h1), g -> g.line_no)"
    stay = F.expr(f"transform(array_except(sequence(0, size({held}) - 1), {places}), i -> {held}[i])")
    out = out.withColumn(left, F.when(F.col(lost).isNull(), F.col(held)).otherwise(stay))
    changed = F.when(F.col(lost).isNull(), text).otherwise(F.array_join(left, "\n"))
    size = F.coalesce(F.size(held), F.lit(0))
    return out.select(
        *[(changed if c == text_col else F.col(f"`{c}`")).alias(c) for c in rest],
        F.when(text.isNull(), 0).otherwise(size).alias("n_lines"),
        F.when(F.col(lost).isNull() | text.isNull(), 0).otherwise(size - F.size(left)).alias("n_dropped"),
    )
