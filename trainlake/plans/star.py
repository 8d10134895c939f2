"""The exercise star with its bridges and the view over it, held to its contracts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from trainlake.operators.joins import gold_view
from trainlake.operators.quality import require_contract, require_not_null, require_unique
from trainlake.plans.lake import Lake
from trainlake.schemas import EXERCISES_DIM, INSTRUCTIONS_BRIDGE, MUSCLES_BRIDGE
from trainlake.sources.readers import read_table
from trainlake.sources.writers import write_table

KEY = "exercise_id"


def run_gold_view(spark: SparkSession, lake: Lake) -> str:
    """Write the exercise view. The sources must have their declared columns, and the key of the
    exercises must be unique and never NULL; else nothing is written."""
    exercises = require_contract(read_table(spark, lake.gold("exercises_dim")), EXERCISES_DIM, "exercises_dim")
    muscles = require_contract(read_table(spark, lake.gold("muscles_bridge")), MUSCLES_BRIDGE, "muscles_bridge")
    steps = require_contract(read_table(spark, lake.gold("instructions_bridge")), INSTRUCTIONS_BRIDGE, "instructions_bridge")
    require_unique(require_not_null(exercises, KEY, "exercises_dim"), KEY, "exercises_dim")
    write_table(gold_view(exercises, muscles, steps), lake.gold("gold_view"), sort=[KEY])
    return lake.gold("gold_view")
