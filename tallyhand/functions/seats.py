"""Seat order and position names."""

from pyspark.sql import Column, functions as F

from tallyhand.functions.columns import lookup

# Position names in dealing order from the button, and the order in
# which names disappear when the table is short.
SHORT_TABLE = ["BTN", "SB", "BB", "EP", "MP", "CO"]
FULL_TABLE = ["BTN", "SB", "BB", "EP", "EP2", "MP1", "MP2", "MP3", "CO"]
SHORT_DROPS = ["EP", "MP"]
FULL_DROPS = ["MP3", "MP2", "MP1", "EP2", "EP"]

BUCKET = {
    "EP": "EP", "EP2": "EP",
    "MP": "MP", "MP1": "MP", "MP2": "MP", "MP3": "MP",
    "CO": "LP", "BTN": "LP",
}

# order of play before the flop, one scale for both table sizes
PLAY_ORDER = {
    "EP": 1, "EP2": 2, "MP1": 3, "MP": 3, "MP2": 4, "MP3": 5, "CO": 6, "BTN": 7, "SB": 8, "BB": 9,
}

# The second naming, used by the text counters (by table size,
# clockwise from the button), and the broad class of each name.
NAMED_SEATS = {
    2: ["BTN/SB", "BB"],
    3: ["BTN", "SB", "BB"],
    4: ["BTN", "SB", "BB", "CO"],
    5: ["BTN", "SB", "BB", "MP", "CO"],
    6: ["BTN", "SB", "BB", "UTG", "MP", "CO"],
    7: ["BTN", "SB", "BB", "UTG", "UTG+1", "MP", "CO"],
    8: ["BTN", "SB", "BB", "UTG", "UTG+1", "MP", "HJ", "CO"],
    9: ["BTN", "SB", "BB", "UTG", "UTG+1", "UTG+2", "MP", "HJ", "CO"],
}
NAMED_CLASS = {
    "UTG": "EP", "UTG+1": "EP", "UTG+2": "EP",
    "MP": "MP", "MP+1": "MP", "MP+2": "MP", "HJ": "MP",
    "CO": "CO", "BTN": "BTN",
}


def seat_names(n_players: int) -> list[str]:
    """Position names for a table of ``n_players``, from the button clockwise."""
    full = n_players > 6
    names, drops = (FULL_TABLE, FULL_DROPS) if full else (SHORT_TABLE, SHORT_DROPS)
    gone = set(drops[: max(0, len(names) - min(n_players, 9))])
    return [name for name in names if name not in gone][:n_players]


def from_button(players: Column, button: Column) -> Column:
    """Players as ``array<struct<name, seat>>`` in order from the button seat.

    A button on an empty seat falls back to the lowest seat.
    """
    seats = F.transform(players, lambda p: p["seat"])
    start = F.when(F.array_contains(seats, button), button).otherwise(F.array_min(seats))
    keyed = F.transform(
        players,
        lambda p: F.struct(
            F.pmod(p["seat"] - start, F.lit(100)).alias("turn"),
            p["seat"].alias("seat"),
            p["name"].alias("name"),
        ),
    )
    return F.array_sort(keyed)


def named_positions(players: Column, button: Column, naming: dict[int, list[str]] | None = None) -> Column:
    """``array<struct<name, pos>>``; empty when there is no button or no player."""
    sizes = naming or {n: seat_names(n) for n in range(1, 10)}
    # at a larger table the first nine from the button have the names of nine
    listed = F.size(players) if naming else F.least(F.size(players), F.lit(9))
    names_for = F.try_element_at(
        F.create_map(*[c for n, v in sizes.items() for c in (F.lit(n), F.array(*map(F.lit, v)))]),
        listed,
    )
    order = from_button(players, button)
    zipped = F.transform(order, lambda p, i: F.struct(p["name"].alias("name"), F.get(names_for, i).alias("pos")))
    ready = (F.coalesce(button, F.lit(0)) != 0) & (F.coalesce(F.size(players), F.lit(0)) > 0)
    empty = F.array().cast("array<struct<name:string,pos:string>>")
    return F.coalesce(
        F.when(ready, F.filter(zipped, lambda x: x["name"].isNotNull() & x["pos"].isNotNull())), empty
    )


def position_of(positions: Column, name: Column) -> Column:
    hits = F.filter(positions, lambda x: x["name"] == name)
    return F.get(hits, F.size(hits) - 1)["pos"]


def player_at(positions: Column, pos: Column) -> Column:
    hits = F.filter(positions, lambda x: x["pos"] == pos)
    return F.get(hits, F.size(hits) - 1)["name"]


def bucket_of(pos: Column) -> Column:
    return lookup(BUCKET, pos)
