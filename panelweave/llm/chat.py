"""Chat formatting by rotating the perspective among the speakers of a dialogue.

DataFrame functions only.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rotate(turns: DataFrame, *, narrators: tuple[str, ...] = ("system",), part_turns: int = 64, opening: str = "<|im_start|>", closing: str = "<|im_end|>\n") -> DataFrame:
    """A training text for every participant of a conversation: that speaker as assistant, others as named users.

    Columns: conv_id, perspective, part, n_turns, text, masks. A long conversation comes in parts of turns numbered alike
    by turn // part_turns; the parts in order are the whole rendering, so no task holds a whole long dialogue.
    masks lists the spans (start-end, code points within the part, end exclusive) that the assistant is
    trained on: its text and the closing mark. Narrators keep their role and get no perspective; a conversation's first
    turn of a narrator opens each later part again (n_turns does not count it there).
    Texts and roles cannot forge a turn: what looks like a mark (`<|im_`) gets one bar more (`<||im_`), as do such runs of bars,
    so the text can be had back; blanks and line ends within a role are written as one space.
    Null texts are empty, null roles are the speaker `unknown`, null turns come first (as part -1). Turns with
    the same number are ordered by role and text; repeated rows are turns of their own. Conversations of narrators alone, rows
    without conv_id and an empty table give no rows; texts of any length stay whole; other columns stay out.
    """
    rows = turns.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("said"))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long")).withColumn("again", F.lit(False))
    speakers = rows.filter(~F.col("role").isin(*narrators)).select("conv_id", F.col("role").alias("perspective")).distinct()
    first = rows.filter(F.col("role").isin(*narrators)).groupBy("conv_id").agg(F.min(F.struct("turn", "role", "said", F.col("part").alias("of"))).alias("x")).select("conv_id", "x.*")
    later = rows.select("conv_id", "part").distinct().join(first, "conv_id").filter("part > of")
    seen = rows.unionByName(later.select("conv_id", "turn", "role", "said", "part", F.lit(True).alias("again"))).join(speakers, "conv_id")
    own = F.col("role") == F.col("perspective")
    safe = lambda c: F.regexp_replace(c, r"<(\|+)im_", r"<$1|im_")
    name = safe(F.regexp_replace("role", r"\s+", " "))
    head = F.when(F.col("role").isin(*narrators), name).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name))
    seen = seen.withColumn("said", safe("said"))
    seen = seen.withColumn("own", own).withColumn("head", F.concat(F.lit(opening), head, F.lit("\n"))).withColumn("piece", F.concat("head", "said", F.lit(closing)))
    group = ["conv_id", "perspective", "part"]
    order = Window.partitionBy(*group).orderBy(F.desc("again"), "turn", "role", "said")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = seen.withColumn("at", before).withColumn("place", F.row_number().over(order))
    span = F.when(F.col("own"), F.concat((F.col("at") + F.length("head")).cast("string"), F.lit("-"), (F.col("at") + F.length("piece") - F.lit(1 if closing.endswith("\n") else 0)).cast("string")))
    said = F.array_sort(F.collect_list(F.struct("place", "piece", span.alias("span"))))
    out = seen.groupBy(*group).agg(F.count(F.when(~F.col("again"), 1)).alias("n_turns"), said.alias("said"))
    return out.select(*group, "n_turns", F.array_join(F.col("said.piece"), "").alias("text"), F.array_join(F.col("said.span"), ",").alias("masks"))


ROTATE_SQL = """
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said,
         CAST(coalesce(floor(turn / 64.0), -1) AS BIGINT) AS part
  FROM conversations WHERE conv_id IS NOT NULL
), speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM rows_ WHERE role <> 'system'
), opening AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS k FROM rows_ WHERE role = 'system'
), every AS (
  SELECT *, 0 AS again FROM rows_
  UNION ALL SELECT o.conv_id, o.turn, o.role, o.said, p.part, 1 FROM opening o JOIN (SELECT DISTINCT conv_id, part FROM rows_) p ON p.conv_id = o.conv_id AND p.part > o.part WHERE k = 1
), seen AS (
  SELECT r.conv_id, turn, role, part, again, perspective, regexp_replace(said, '<(\\|+)im_', '<\\1|im_', 'g') AS said,
         '<|im_start|>' || CASE WHEN role = 'system' THEN role WHEN role = perspective THEN 'assistant' ELSE 'user name=' || regexp_replace(regexp_replace(role, '\\s+', ' ', 'g'), '<(\\|+)im_', '<\\1|im_', 'g') END || chr(10) AS head
  FROM every r JOIN speakers USING (conv_id)
), pieces AS (SELECT *, head || said || '<|im_end|>' || chr(10) AS piece FROM seen
), placed AS (
  SELECT *, row_number() OVER w AS place,
         coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, perspective, part ORDER BY again DESC, turn NULLS FIRST, role, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_
  FROM pieces WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY again DESC, turn NULLS FIRST, role, said)
)
SELECT conv_id, perspective, part, count(*) FILTER (WHERE again = 0) AS n_turns, string_agg(piece, '' ORDER BY place) AS text,
       coalesce(string_agg(CAST(start_ + length(head) AS BIGINT)::VARCHAR || '-' || CAST(start_ + length(piece) - 1 AS BIGINT)::VARCHAR, ',' ORDER BY place) FILTER (WHERE role = perspective), '') AS masks
FROM placed GROUP BY conv_id, perspective, part
"""
