"""Street words: one betting round written as a short string.

A round is at most a few dozen actions, so it is turned once into two letters per
action, an upper-case letter for *who* and a lower-case one for *what*:

    "AfHrBcHk" = A folds, hero raises, B calls, hero checks

The alphabets do not overlap, so a pattern can never start in the middle of an
action, and every order-dependent question ("did the raiser check before the hero
bet?") becomes a single JVM regex over a short string instead of a nest of
higher-order functions over an array of structs.
"""

from pyspark.sql import Column, functions as F

from tallyhand.functions.columns import lookup, yes

HERO, RAISER = "H", "P"
OTHERS = "ABCDEFGIJKLMNOQRSTUVWXYZ"  # the letters left for everybody else

# what: fixed values, one letter per action type
TYPE_LETTER = {
    "FOLD": "f",
    "CHECK": "k",
    "CALL": "c",
    "BET": "b",
    "RAISE": "r",
    "RERAISE": "e",
    "ALLIN": "a",
    "POST_SB": "p",
    "POST_BB": "p",
    "POST_ANTE": "p",
    "SHOW": "s",
    "MUCK": "m",
}

# beyond those: one CJK ideograph each, so no two actors ever share a letter
MORE_FIRST = 0x4E00
_MORE = "\u4e00-\u9fff"

ANY = f"[A-Z{_MORE}]"
NOT_HERO = f"[A-GI-Z{_MORE}]"


def but(letters: str) -> str:
    """Anybody whose letter is not one of ``letters``."""
    return "[" + "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in letters) + _MORE + "]"


def more_letter(number: Column) -> Column:
    """The letter of the actor at ``number`` (from 1) behind the named ones."""
    return F.decode(F.unhex(F.hex(number.cast("bigint") + (MORE_FIRST - 1))), "UTF-16BE")


def street_word(actions: Column, hero: Column, raiser: Column, roster: Column) -> Column:
    """Encode one street. ``roster`` is the array of distinct actors of the whole hand."""

    def letter(a: Column) -> Column:
        slot = F.array_position(roster, a["actor"]).cast("int")
        return (
            F.when(yes(a["actor"] == hero), F.lit(HERO))
            .when(yes(a["actor"] == raiser), F.lit(RAISER))
            .when(slot.between(1, len(OTHERS)), F.substring(F.lit(OTHERS), slot, F.lit(1)))
            .otherwise(more_letter(F.when(slot > 0, slot - len(OTHERS)).otherwise(F.lit(20_000))))
        )

    def verb(a: Column) -> Column:
        return F.coalesce(lookup(TYPE_LETTER, F.upper(a["type"])), F.lit("u"))

    return F.coalesce(
        F.array_join(F.transform(actions, lambda a: F.concat(letter(a), verb(a))), ""), F.lit("")
    )


def has(word: Column, pattern: str) -> Column:
    return word.rlike(pattern)
