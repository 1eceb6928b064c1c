"""Hand texts written from the derived hands, so parsing can be checked end to end."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import tables

# one header, the seat list, the streets and the ending, as a site would print them
_LINE = """
CASE a.type
  WHEN 'FOLD' THEN concat(a.actor, ': folds')
  WHEN 'CHECK' THEN concat(a.actor, ': checks')
  WHEN 'CALL' THEN concat(a.actor, ': calls ', format_string('%.2f', a.amount))
  WHEN 'BET' THEN concat(a.actor, ': bets ', format_string('%.2f', a.amount))
  WHEN 'POST_SB' THEN concat(a.actor, ': posts small blind 2')
  WHEN 'POST_BB' THEN concat(a.actor, ': posts big blind 4')
  WHEN 'ALLIN' THEN concat(a.actor, ': raises 1.00 to ', format_string('%.2f', a.amount), ' and is all-in')
  ELSE concat(a.actor, ': raises 1.00 to ', format_string('%.2f', a.amount)) END
"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(h, file_id, month, text): one hand text per derived hand."""
    hands = tables.hands(spark, sf_dir)

    def section(street: str, title: str):
        acts = F.expr(f"transform(streets.{street}.actions, a -> {_LINE})")
        body = F.array_join(acts, "\n")
        return F.when(F.size(F.col(f"streets.{street}.actions")) > 0, F.concat(F.lit(f"\n*** {title} ***\n"), body)).otherwise(F.lit(""))

    header = F.format_string(
        "PokerStars Hand #%d: Tournament #%d, $1+$1 USD Hold'em No Limit - Level I (2/4) - %s ET\n"
        "Table '%d 1' 9-max Seat #%d is the button\n",
        F.col("h"), F.col("h") % 40,
        F.translate(F.substring("timestamp_utc", 1, 19), "-T", "/ "), F.col("h"), F.col("button_seat"),
    )
    seat_lines = F.expr(
        "array_join(transform(players, p -> concat('Seat ', p.seat, ': ', p.name, ' (',"
        " CAST(p.stack_chips AS INT), ' in chips)')), '\\n')"
    )
    won = F.expr("array_contains(winners, hero)")
    shown = F.expr("h % 2 = 0")
    text = F.concat(
        header,
        seat_lines,
        F.lit("\ndealer: posts big blind 4\n*** HOLE CARDS ***\nDealt to "),
        F.col("hero"),
        F.lit(" [Ah Kd]\n"),
        F.expr(f"array_join(transform(streets.preflop.actions, a -> {_LINE}), '\\n')"),
        section("flop", "FLOP"),
        section("turn", "TURN"),
        section("river", "RIVER"),
        F.when(shown, F.concat(F.lit("\n*** SHOW DOWN ***\n"), F.col("hero"), F.lit(": shows [Ah Kd] (high card)"))).otherwise(F.lit("")),
        F.when(won, F.concat(F.lit("\n"), F.col("hero"), F.lit(" collected 12 from pot"))).otherwise(F.lit("")),
        F.lit("\n*** SUMMARY ***\nTotal pot 12\n"),
        F.expr(
            "array_join(transform(players, p -> concat('Seat ', p.seat, ': ', p.name,"
            " CASE WHEN p.name = hero THEN ' (button) mucked' ELSE ' folded before Flop' END)), '\\n')"
        ),
    )
    return hands.select("h", "site", "file_id", "timestamp_utc", "hero", text.alias("text"))


# How each site prints a hand: colon after a name, seat, blind, amounts, markers, header. ``{a}`` is the actor, ``{m}`` the amount.
_HOLDEM = {"deal": "*** HOLE CARDS ***", "flop": "*** FLOP *** [2c 3d 4h]", "turn": "*** TURN *** [2c 3d 4h] [5s]", "river": "*** RIVER *** [2c 3d 4h 5s] [9c]", "shown": "*** SHOW DOWN ***\n", "end": "*** SUMMARY ***\n"}
FORMS = {
    "pokerstars": {**_HOLDEM, "colon": ":", "seat": "format_string('Seat %d: %s (%d in chips)', p.seat, p.name, CAST(p.stack_chips AS INT))", "money": "%.2f", "to": "raises 1.00 to {m}", "blind": "4",
                   "header": "concat('PokerStars Hand #', h, ': Tournament #7, $1+$1 USD Holdem No Limit - Level I (2/4) - 2024/05/06 07:08:09 ET')"},
    "gg": {**_HOLDEM, "colon": ":", "seat": "format_string('Seat %d: %s (%,d in chips)', p.seat, p.name, CAST(p.stack_chips AS INT))", "money": "%,.2f", "to": "raises 1.00 to {m}", "blind": "4",
           "header": "concat('Poker Hand #TM', h, ': Tournament #7, Daily Holdem No Limit - Level1(2/4) - 2024/05/06 07:08:09')"},
    "wpn": {**_HOLDEM, "colon": "", "seat": "format_string('Seat %d: %s (%.2f)', p.seat, p.name, p.stack_chips)", "money": "%.2f", "to": "raises 1.00 to {m}", "blind": "4.00",
            "header": "concat('Game Hand #', h, ' - Tournament #7 - Holdem (No Limit) - Level 1 (2.00/4.00) - 2024/05/06 07:08:09 UTC')"},
    "winamax": {**_HOLDEM, "colon": "", "seat": "format_string('Seat %d: %s (%d)', p.seat, p.name, CAST(p.stack_chips AS INT))", "money": "%.2f", "to": "raises 1.00 to {m}", "blind": "4",
                "header": "concat('Winamax Poker - Tournament \"T\" buyIn: 1 level: 1 - HandId: #', h, ' - Holdem no limit (2/4) - 2024/05/06 07:08:09 UTC')"},
    "888": {"deal": "** Dealing down cards **", "flop": "** Dealing flop ** [ 2c, 3d, 4h ]", "turn": "** Dealing turn ** [ 5s ]", "river": "** Dealing river ** [ 9c ]", "shown": "** Summary **\n", "end": "",
            "colon": "", "seat": "format_string('Seat %d: %s ( %,d )', p.seat, p.name, CAST(p.stack_chips AS INT))", "money": "[%.2f]", "to": "raises {m}", "blind": "[4]",
            "header": "concat('#Game No : ', h, '\\n***** 888poker Hand History for Game ', h, ' *****\\n2/4 Blinds No Limit Holdem - *** 06 05 2024 07:08:09\\nTournament #7 1 + 1')"},
}


def site_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(h, site, hero, text): each hand as its site prints it."""
    said = None
    for site, form in FORMS.items():
        colon, amount = form["colon"], f"format_string('{form['money']}', a.amount)"
        raises = "concat('" + form["to"].replace("{m}", f"', {amount}, '") + "')"
        line = f"""concat(a.actor, '{colon} ', CASE a.type WHEN 'FOLD' THEN 'folds' WHEN 'CHECK' THEN 'checks' WHEN 'CALL' THEN concat('calls ', {amount}) WHEN 'BET' THEN concat('bets ', {amount})
            WHEN 'POST_SB' THEN 'posts small blind [2]' WHEN 'POST_BB' THEN 'posts big blind {form['blind']}' WHEN 'ALLIN' THEN concat({raises}, ' and is all-in') ELSE {raises} END)"""
        section = lambda s: F.expr(f"if(size(streets.{s}.actions) > 0, concat('\\n{form[s]}\\n', array_join(transform(streets.{s}.actions, a -> {line}), '\\n')), '')")  # noqa: B023, E731
        shown, won = F.expr("h % 2 = 0"), F.expr("array_contains(winners, hero)")
        text = F.concat(
            F.expr(form["header"]), F.expr("concat('\\nTable 7 9-max Seat ', if(site = '888', '', '#'), button_seat, ' is the button\\n')"),
            F.expr(f"array_join(transform(players, p -> {form['seat']}), '\\n')"), F.lit(f"\ndealer{colon} posts big blind {form['blind']}\n{form['deal']}\nDealt to "), F.col("hero"), F.lit(" [Ah Kd]\n"),
            F.expr(f"array_join(transform(streets.preflop.actions, a -> {line}), '\\n')"), section("flop"), section("turn"), section("river"),
            F.when(shown, F.concat(F.lit(f"\n{form['shown']}"), "hero", F.lit(f"{colon} shows [Ah Kd]"))).otherwise(F.lit("")),
            F.when(won, F.concat(F.lit("\n"), "hero", F.lit(" collected 12 from pot"))).otherwise(F.lit("")), F.lit(f"\n{form['end']}Total pot 12"),
        )
        said = F.when(F.col("site") == site, text) if said is None else said.when(F.col("site") == site, text)
    return tables.hands(spark, sf_dir).where(F.col("site").isin(*FORMS)).select("h", "site", "hero", said.alias("text"))
