"""Chat transcripts as training windows of bounded length.

Prefix sums of the turns' tokens deal each conversation out over stretches, and
those into spans of whole turns.  Every window opens with the system turn, repeats a little of what came
before its span, and then has the span; only assistant texts of the span itself
count for the loss, so each is learned once.  All of it is DataFrame
expressions.

Format of a turn: ``### role: text</turn>\\n``.  In roles and texts a backslash
becomes ``\\b``, ``#`` becomes ``\\h``, ``<`` becomes ``\\l`` and (in roles) ``:``
becomes ``\\c``, so no text can close a turn or open another, and it all reads back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

OPEN, SAYS, CLOSE = "### ", ": ", "</turn>\n"
#: Budgets in a stretch, in which spans are filled one after the other.
STRETCH = 16
#: Turns whose prefix sums are taken together before those of the blocks.
BLOCK = 256


def escape(c: Column, role: bool = False) -> Column:
    for plain, mark in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")) + (((":", "\\c"),) if role else ()):
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def unescape(c: Column, role: bool = False) -> Column:
    for plain, mark in (((":", "\\c"),) if role else ()) + (("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def default_tokens(text: Column) -> Column:
    """An estimate for any script: a token for three UTF-8 bytes begun, and 4 for the template."""
    return F.ceil(F.octet_length(text) / 3).cast("long") + 4


def _positions(turns: DataFrame) -> DataFrame:
    """Turns with their ordinal and the tokens before them, in two steps: within blocks of turns, and over the blocks."""
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text")]
    rows = turns.withColumn("__block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    sums = rows.groupBy("conv", "__block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    over = Window.partitionBy("conv").orderBy("__block")
    sums = sums.select(F.col("conv").alias("c"), F.col("__block").alias("b"), (F.sum("t").over(over) - F.col("t")).alias("t0"), (F.sum("n").over(over) - F.col("n")).alias("n0"))
    inner = Window.partitionBy("conv", "__block").orderBy(*order)
    rows = rows.withColumn("__n", F.row_number().over(inner) - 1).withColumn("__t", F.sum("tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    rows = rows.join(sums, F.col("conv").eqNullSafe(F.col("c")) & (F.col("__block") == F.col("b")))
    return rows.select("conv", "role", "text", "tokens", (F.col("n0") + F.col("__n")).alias("ord"), (F.col("t0") + F.col("__t")).alias("before"))


def _earlier(turns: str, upto: str, most: int) -> str:
    """SQL: the turns before number ``upto``, ``most`` of them at most."""
    return f"slice({turns}, greatest({upto} - {most}, 0) + 1, least({upto}, {most}))"


def _history(back: str, limit: str) -> str:
    """SQL: (sum, more, kept) of the turns of ``back`` from the nearest on, while they fit and are not the system turn."""
    fits = f"h.more AND (t.ord > 0 OR head IS NULL) AND h.sum + t.tokens <= {limit}"
    start = f"struct(0L AS sum, true AS more, slice({back}, 1, 0) AS kept)"
    return f"aggregate(reverse({back}), {start}, (h, t) -> IF({fits}, struct(h.sum + t.tokens AS sum, true AS more, concat(array(t), h.kept) AS kept), struct(h.sum AS sum, false AS more, h.kept AS kept)))"


def _spans(budget: int, history_turns: int, history_tokens: int) -> str:
    """SQL over a stretch's ``turns`` in order: the number at which each span begins.

    A span takes turns while they fit into what the system turn and the history
    before it leave of the budget; the history before a stretch's first turn is
    taken to be as long as it may be, and before a conversation's there is none.
    """
    held = _history(_earlier("turns", "s.i", history_turns), f"{history_tokens}L") + ".sum"
    room = f"CASE WHEN t.ord = 0 THEN {budget}L WHEN s.i = 0 THEN {budget - history_tokens}L - system ELSE {budget}L - system - {held} END"
    opens = f"struct(concat(s.starts, array(s.i)) AS starts, t.tokens AS used, {room} AS room, s.i + 1 AS i)"
    goes_on = "struct(s.starts AS starts, s.used + t.tokens AS used, s.room AS room, s.i + 1 AS i)"
    return f"aggregate(turns, struct(cast(array() AS array<int>) AS starts, 0L AS used, 0L AS room, 0 AS i), (s, t) -> IF(s.i = 0 OR s.used + t.tokens > s.room, {opens}, {goes_on}), s -> s.starts)"


def chat_windows(conversations: DataFrame, budget: int = 1024, history_turns: int = 2, history_tokens: int = 256, target_role: str = "assistant", system_role: str = "system", tokens: Column | None = None) -> DataFrame:
    """(conv_id, window, n_turns, n_repeated, tokens, formatted, loss) a row a window.

    ``loss`` is an array of (start, length) in code points.  ``tokens`` says how
    many tokens a turn takes with its template, by the columns of the table;
    ``default_tokens`` of the text if it isn't given.  Prefix sums deal a
    conversation over stretches of STRETCH budgets; in each, spans of whole turns
    are filled one after the other.  A window has the system turn, a bounded
    history and a span, and keeps to the budget; only where the system turn and a
    single turn are over it together, they are a window by themselves, without
    history: turns are never cut.

    Null texts and roles are empty; a null conv_id is a conversation of its own.
    Turns with one number go by role, then text, null numbers first; repeated
    rows are turns of their own.  The system turn is the first turn, if that has
    the role.  An empty table gives no rows; other columns are not read.
    """
    counted = default_tokens(F.coalesce("text", F.lit(""))) if tokens is None else tokens
    turns = conversations.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.greatest(counted.cast("long"), F.lit(1)).alias("tokens"))
    rows = table(_positions(turns))  # read for stretches and system turns
    system = rows.where((F.col("ord") == 0) & (F.col("role") == system_role)).select(F.col("conv").alias("sc"), F.struct("ord", "role", "text", "tokens").alias("head"))
    own = rows.groupBy("conv", F.floor(F.col("before") / (STRETCH * budget)).alias("at")).agg(F.array_sort(F.collect_list(F.struct("ord", "role", "text", "tokens"))).alias("turns"))
    own = own.join(system, F.col("conv").eqNullSafe(F.col("sc")), "left").withColumn("system", F.coalesce("head.tokens", F.lit(0)).cast("long"))
    own = table(own.select("conv", "at", "turns", "head", "system").withColumn("starts", F.expr(_spans(budget, history_turns, history_tokens))))
    # The turns that a stretch's first windows may repeat are the last ones of the stretch before it.
    tail = F.expr(f"slice(turns, greatest(size(turns) - {history_turns}, 0) + 1, {history_turns})").alias("tail")
    after = F.lead("at").over(Window.partitionBy("conv").orderBy("at")).alias("ta")
    lead = own.select(F.col("conv").alias("tc"), after, tail).where("ta IS NOT NULL")
    own = own.join(lead, F.col("conv").eqNullSafe(F.col("tc")) & (F.col("at") == F.col("ta")), "left").withColumn("tail", F.coalesce("tail", F.expr("slice(turns, 1, 0)")))

    bounds = "transform(starts, (s, k) -> struct(s AS a, IF(k + 1 < size(starts), starts[k + 1], size(turns)) AS b))"
    cuts = own.withColumn("all", F.concat("tail", "turns")).select("conv", "all", "head", "system", F.size("tail").alias("n"), F.explode(F.expr(bounds)).alias("cut"))
    spans = cuts.select("conv", "head", "system", F.expr("slice(all, n + cut.a + 1, cut.b - cut.a)").alias("own"), F.expr(_earlier("all", "(n + cut.a)", history_turns)).alias("back"))
    spans = spans.withColumn("used", F.expr("system * int(own[0].ord > 0) + aggregate(own, 0L, (s, t) -> s + t.tokens)"))
    spans = spans.withColumn("history", F.expr(_history("back", f"least({history_tokens}L, {budget}L - used)")))
    heads = F.when(F.expr("head IS NOT NULL AND own[0].ord > 0"), F.array("head")).otherwise(F.expr("slice(own, 1, 0)"))
    packed = spans.withColumn("repeated", F.concat(heads, "history.kept")).select("conv", F.expr("own[0].ord").alias("window"), F.expr("used + history.sum").alias("tokens"), F.size("repeated").alias("n_repeated"), F.concat("repeated", "own").alias("all"))

    def piece(t: Column, i: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(t["role"], True), F.lit(SAYS))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), ((t["role"] == target_role) & (i >= F.col("n_repeated"))).alias("own"))

    packed = packed.withColumn("p", F.transform("all", piece)).drop("all")
    # The pieces' own lengths give where each loss span starts.
    sized = f"transform(p, x -> length(x.head) + length(x.body) + {len(CLOSE)})"
    packed = packed.withColumn("ends", F.expr(f"aggregate({sized}, array(0), (a, n) -> concat(a, array(element_at(a, -1) + n)))"))
    loss = "transform(filter(transform(p, (x, i) -> struct(x.own, ends[i] + length(x.head) AS start, length(x.body) AS length)), x -> x.own), x -> struct(x.start, x.length))"
    formatted = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    return packed.select(F.col("conv").alias("conv_id"), "window", F.size("p").cast("long").alias("n_turns"), F.col("n_repeated").cast("long").alias("n_repeated"), "tokens", formatted.alias("formatted"), F.expr(loss).alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read out of the formatted windows.

    The digests are over a whole conversation, which so comes together in one
    row here; the windows themselves never do.
    """
    shut = F.split("formatted", CLOSE.replace("\n", "\\n"), -1)
    own = F.slice(shut, F.col("n_repeated").cast("int") + 1, F.size(shut) - 1 - F.col("n_repeated").cast("int"))

    def turn(t: Column) -> Column:
        role = F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), SAYS, 1)
        text = F.substr(t, F.lit(len(OPEN) + len(SAYS) + 1) + F.length(role))
        return F.concat(unescape(role, True), F.lit("\n"), unescape(text), F.lit("\n"))

    losses = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    read = windows.select("conv_id", "window", F.size(own).alias("n"), F.array_join(F.transform(own, turn), "").alias("turns"), F.array_join(losses, "").alias("losses"), F.length("formatted").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "losses"))).alias("w"), F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"))
    turns, losses = F.array_join("w.turns", ""), F.array_join("w.losses", "")
    return whole.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(losses).cast("long").alias("loss_chars"), F.sha2(losses, 256).alias("loss_sha256"), "formatted_chars")
