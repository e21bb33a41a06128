"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := turn*
    turn         := "### " role ": " text " </turn>" LF

Inside a role or text the control strings ``###`` and ``</turn>`` may be written as codes that begin with a
backslash. The parser is deterministic: it cuts at the turn ends, reads the role up to the first
colon and always decodes codes. A turn is rendered as it is, parsed again and compared with its
source; where the two differ, the turn is rendered with its control strings and backslashes
escaped. If the conversation as a whole then still reads differently, all of its turns are escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEAD, MID, TAIL = "### ", ": ", " </turn>\n"
# Source strings and codes. Every code is a backslash and a letter, and an encoded text has no
# other backslashes, so replacing the codes in this order undoes the encoding. Roles also
# encode what would end them early.
CODES = (("\\", "\\e"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_CODES = ((":", "\\c"), ("\n", "\\n"))


def escaped(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, codes=CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def rendered(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(MID), body, F.lit(TAIL))


def turn_pieces(formatted: Column) -> Column:
    """The turns of a formatted conversation, without their ends."""
    cut = F.split(formatted, r"\Q" + TAIL + r"\E", -1)
    return F.slice(cut, 1, F.size(cut) - 1)


def parsed(piece: Column) -> Column:
    """(role, text, raw): decoded role and text, and the text as it stands in the output.

    Null for a piece that the grammar does not allow: a bare control string in its role or text.
    """
    at = F.instr(piece, MID)
    role = F.substring(piece, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)
    raw = F.substring(piece, at + len(MID), F.length(piece))
    bare = F.contains(raw, F.lit("###")) | F.contains(raw, F.lit("</turn>")) | F.contains(role, F.lit("###")) | F.contains(role, F.lit("</turn>"))
    told = F.struct(unescaped(role, CODES + ROLE_CODES).alias("role"), unescaped(raw).alias("text"), raw.alias("raw"))
    return F.when((at > 0) & piece.startswith(HEAD) & ~bare, told)


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, formatted, loss_spans, n_escaped) with a row per conversation.

    ``loss_spans`` are (start, length) in characters of ``formatted``: the texts of assistant
    turns as they stand there. Rows are ordered by turn (nulls first), then role and text, so
    repeated turns have a fixed order. Null roles and texts are empty; a null conversation id is a
    conversation of its own. Extra columns are not read. An empty table gives an empty table.
    """
    c = F.col
    rows = turns.select(
        c(conv_col).alias("_conv"), c(turn_col).alias("_turn"), F.coalesce(c(role_col), F.lit("")).alias("_role"), F.coalesce(c(text_col), F.lit("")).alias("_text")
    )
    plain = rendered(c("_role"), c("_text"))

    def coded(role: Column, text: Column) -> Column:
        return rendered(escaped(role, CODES + ROLE_CODES), escaped(text))

    back = F.transform(turn_pieces(plain), parsed)
    same = (F.size(back) == 1) & (back[0]["role"] == c("_role")) & (back[0]["text"] == c("_text"))
    rows = rows.withColumn("_same", F.coalesce(same, F.lit(False)))
    one = rows.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("_turn", "_role", "_text", "_same"))).alias("_t"))
    first = F.transform("_t", lambda t: F.when(t["_same"], rendered(t["_role"], t["_text"])).otherwise(coded(t["_role"], t["_text"])))
    again = F.transform(turn_pieces(F.array_join(c("_first"), "")), lambda p: F.struct(parsed(p)["role"].alias("r"), parsed(p)["text"].alias("t")))
    source = F.transform("_t", lambda t: F.struct(t["_role"].alias("r"), t["_text"].alias("t")))
    one = one.withColumn("_first", first).withColumn("_whole", again == source)
    final = F.when(c("_whole"), c("_first")).otherwise(F.transform("_t", lambda t: coded(t["_role"], t["_text"])))
    n_escaped = F.when(c("_whole"), F.size(F.filter("_t", lambda t: ~t["_same"]))).otherwise(F.size("_t"))
    one = one.select("_conv", n_escaped.alias("_n"), F.arrays_zip(final.alias("out"), F.transform("_t", lambda t: t["_role"]).alias("role")).alias("_z"))
    # Offsets are running sums over the turns as rows.
    pieces = one.select("_conv", "_n", F.posexplode("_z").alias("_i", "_p"))
    line = Window.partitionBy("_conv").orderBy("_i")
    out, role = c("_p.out"), c("_p.role")
    # The head of a turn is what stands before its first colon and blank.
    head = F.instr(out, MID) + len(MID) - 1
    start = F.coalesce(F.sum(F.length(out)).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + head
    span = F.struct(start.cast("long").alias("start"), (F.length(out) - head - len(TAIL)).cast("long").alias("length"))
    pieces = pieces.select("_conv", "_n", "_i", out.alias("_out"), F.when(role == "assistant", span).alias("_span"))
    done = pieces.groupBy("_conv", "_n").agg(F.sort_array(F.collect_list(F.struct("_i", "_out", "_span"))).alias("_a"))
    return done.select(
        c("_conv").alias(conv_col),
        F.array_join(F.transform("_a", lambda a: a["_out"]), "").alias("formatted"),
        F.filter(F.transform("_a", lambda a: a["_span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        c("_n").cast("long").alias("n_escaped"),
    )


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conversation, turns, loss, formatted_chars): what the parser and the loss mask find in the output.

    ``turns`` are (role, text). ``loss`` are the decoded texts under the mask, in order: the parser's
    turns whose place in the output is a span of the mask.
    """
    c = F.col
    rows = formatted.withColumn("_pieces", F.when(F.length("formatted") > 0, turn_pieces(c("formatted"))))
    each = rows.select(c(conv_col).alias("_conv"), F.length("formatted").cast("long").alias("_chars"), F.posexplode("_pieces").alias("_i", "_p"))
    line = Window.partitionBy("_conv").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("_p") + len(TAIL)).over(line), F.lit(0)) + F.instr("_p", MID) + len(MID) - 1
    each = each.withColumn("_turn", parsed(c("_p"))).withColumn("_start", start.cast("long"))
    mask = rows.select(c(conv_col).alias("_mconv"), F.inline("loss_spans").alias("_mstart", "_mlength"))
    each = each.join(mask, F.col("_conv").eqNullSafe(F.col("_mconv")) & (F.col("_start") == F.col("_mstart")), "left")
    under = F.when(c("_mlength") == F.length("_turn.raw"), c("_turn.text"))
    each = each.select("_conv", "_chars", "_i", "_turn", under.alias("_loss"))
    one = each.groupBy("_conv", "_chars").agg(F.sort_array(F.collect_list(F.struct("_i", "_turn", "_loss"))).alias("_a"))
    return one.select(
        c("_conv").alias(conv_col),
        F.transform("_a", lambda a: F.struct(a["_turn"]["role"].alias("role"), a["_turn"]["text"].alias("text"))).alias("turns"),
        F.filter(F.transform("_a", lambda a: a["_loss"]), lambda x: x.isNotNull()).alias("loss"),
        c("_chars").alias("formatted_chars"),
    )
