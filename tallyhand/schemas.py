"""Explicit schemas. Nothing in the package infers a schema from data."""

from pyspark.sql import types as T

ACTION = T.StructType(
    [
        T.StructField("actor", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("to_amount", T.DoubleType()),
        T.StructField("allin", T.BooleanType()),
        T.StructField("raw_offset", T.IntegerType()),
    ]
)

STREET = T.StructType(
    [
        T.StructField("actions", T.ArrayType(ACTION)),
        T.StructField("board", T.ArrayType(T.StringType())),
    ]
)

STREET_NAMES = ["preflop", "flop", "turn", "river", "showdown"]

STREETS = T.StructType([T.StructField(name, STREET) for name in STREET_NAMES])

PLAYER = T.StructType(
    [
        T.StructField("seat", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("stack_chips", T.DoubleType()),
        T.StructField("is_hero", T.BooleanType()),
    ]
)

HAND = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("tournament_id", T.StringType()),
        T.StructField("tournament_name", T.StringType()),
        T.StructField("tourney_class", T.StringType()),
        T.StructField("file_id", T.StringType()),
        T.StructField("timestamp_utc", T.StringType()),
        T.StructField("month", T.StringType()),
        T.StructField("button_seat", T.IntegerType()),
        T.StructField("table_max", T.IntegerType()),
        T.StructField("blinds", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("players", T.ArrayType(PLAYER)),
        T.StructField("players_dealt_in", T.ArrayType(T.StringType())),
        T.StructField("hero", T.StringType()),
        T.StructField("streets", STREETS),
        T.StructField("any_allin_preflop", T.BooleanType()),
        T.StructField("winners", T.ArrayType(T.StringType())),
        T.StructField("raw_offsets", T.MapType(T.StringType(), T.IntegerType())),
    ]
)

# month x group x stat counters; the long form every report starts from
COUNT_CUBE = T.StructType(
    [
        T.StructField("month", T.StringType()),
        T.StructField("grp", T.StringType()),
        T.StructField("stat_id", T.StringType()),
        T.StructField("opportunities", T.LongType()),
        T.StructField("attempts", T.LongType()),
    ]
)

# The action vocabulary and the enumerations hands may use.
ACTION_TYPES = [
    "POST_SB", "POST_BB", "POST_ANTE", "FOLD", "CHECK", "CALL", "BET", "RAISE",
    "RERAISE", "ALLIN",
]
SITES = ["pokerstars", "gg", "wpn", "winamax", "888", "other"]
