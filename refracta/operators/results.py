"""From model replies to rows of the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refracta.constants import NATURAL_KEY
from refracta.functions.metrics import keyword_complexity
from refracta.functions.responses import error_type, estimated_cost, extract_code
from refracta.functions.scoring import delta_cc
from refracta.schemas import TRANSFORMATIONS
from refracta.sources.catalogue import with_model_attributes


def result_rows(
    cells: DataFrame,
    responses: DataFrame,
    functions: DataFrame,
    catalogue: DataFrame,
    max_attempts: int = 3,
    temperature: float = 0.2,
) -> DataFrame:
    """One row in the schema of ``TRANSFORMATIONS`` per cell of the grid that was tried.

    ``responses`` has the natural key, ``attempt``, ``content``, ``error``, ``tokens_input``,
    ``tokens_output``, ``latency_ms`` and ``timestamp``. The first of ``max_attempts`` attempts
    that gives code counts. A cell without one keeps its last attempt as a failure, with an
    ``error_type`` and no code. Scores stay NULL until the result is scored. Replies outside
    of the grid give no row.

    The grid and the functions are joined by sorting: the size they are planned with is that of
    the table they are derived from, which says too little for a broadcast.
    """
    key = list(NATURAL_KEY)
    originals = functions.select(
        F.col("id").alias("function_id"), "language", F.col("cyclomatic_complexity").alias("__before")
    ).hint("merge")
    wanted = cells.select(key).hint("merge")
    tried = responses.filter(F.col("attempt") <= max_attempts).join(wanted, key, "left_semi")
    read = tried.join(originals, "function_id", "left").withColumn(
        "transformed_code", extract_code(F.col("content"), F.col("language"))
    )
    failed = F.col("transformed_code").isNull()
    best = Window.partitionBy(*key).orderBy(
        failed, F.when(failed, -F.col("attempt")).otherwise(F.col("attempt")), "timestamp"
    )
    chosen = read.drop("content").withColumn("__rn", F.row_number().over(best)).filter("__rn = 1")
    priced = with_model_attributes(chosen, catalogue)
    rows = priced.withColumns(
        {
            "temperature": F.lit(temperature),
            "delta_cc": delta_cc(F.col("__before"), keyword_complexity(F.col("transformed_code"))),
            "cost_usd": estimated_cost(
                F.col("tokens_input"), F.col("tokens_output"), F.col("cost_per_1k_tokens"), F.col("tier").isNotNull()
            ),
            "error_type": error_type(F.col("error"), F.col("transformed_code")),
            **{c: F.lit(None) for c in ("preservation", "diversity", "effort", "se_score")},
        }
    )
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TRANSFORMATIONS.fields])
