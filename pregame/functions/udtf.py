"""SQL surface of the Elo replay: ``SELECT * FROM elo(TABLE(games))``.

The function itself asks Spark to partition its table argument by league and to order it by date and id,
so a caller cannot feed it a wrong order. Rows are streamed; the state is one rating per team.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

OUT = T.StructType(
    [
        T.StructField("league", T.StringType()),
        T.StructField("game_id", T.LongType()),
        T.StructField("home_elo", T.DoubleType()),
        T.StructField("away_elo", T.DoubleType()),
    ]
)
NEEDED = {"league", "game_id", "season", "game_date", "home_team", "away_team", "home_pts", "away_pts"}


class Elo:
    """K = 20, each team keeps two thirds of its distance to 1500 at its first game of a new season."""

    @staticmethod
    def analyze(games: AnalyzeArgument) -> AnalyzeResult:
        if not games.isTable or not NEEDED <= set(games.dataType.fieldNames()):
            raise ValueError(f"elo needs a table argument with the columns {sorted(NEEDED)}")
        return AnalyzeResult(
            schema=OUT,
            partitionBy=[PartitioningColumn("league")],
            orderBy=[OrderingColumn("game_date"), OrderingColumn("game_id")],
        )

    def __init__(self) -> None:
        from pregame.operators.ratings import BASE, EloParams, _Ledger

        p = EloParams()
        self.ledger = _Ledger(p.k, p.keep, p.home, p.mov, p.boundary, 0.0, BASE)

    def eval(self, row):
        margin = row["home_pts"] - row["away_pts"]
        h, a, *_ = self.ledger.play(row["season"], row["home_team"], row["away_team"], margin, False, False, False)
        yield row["league"], row["game_id"], h, a


def register(spark: SparkSession) -> None:
    spark.udtf.register("elo", udtf(Elo))
