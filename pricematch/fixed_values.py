"""Fixed values.

Everything in this module is data the results depend on: label dictionaries,
the allow-list, the complementary-selection dictionaries, word lists, column
widths and per-feed settings. The entries are stated as they must be, in their
natural order; change one and the output changes.
"""

from __future__ import annotations

# Fixed value: text between a market type and its outcome in a label.
LABEL_SEPARATOR = " <> "

# Fixed value: the id of an event that carries no shared id.
NO_ID = -1

# Canonical labels that may enter the quotes table.
ALLOWED_LABELS = [
    "1X2 <> 1",
    "1X2 <> 2",
    "1X2 <> X",
    "U/O 0.5 <> OVER 0.5",
    "U/O 1.5 <> OVER 1.5",
    "U/O 2.5 <> OVER 2.5",
    "U/O 3.5 <> OVER 3.5",
    "U/O 4.5 <> OVER 4.5",
    "U/O 5.5 <> OVER 5.5",
    "U/O 6.5 <> OVER 6.5",
    "U/O 0.5 <> UNDER 0.5",
    "U/O 1.5 <> UNDER 1.5",
    "U/O 2.5 <> UNDER 2.5",
    "U/O 3.5 <> UNDER 3.5",
    "U/O 4.5 <> UNDER 4.5",
    "U/O 5.5 <> UNDER 5.5",
    "U/O 6.5 <> UNDER 6.5",
    "GOAL/NOGOAL <> GOAL",
    "GOAL/NOGOAL <> NOGOAL",
    "ESPULSIONE SI/NO <> NO",
    "ESPULSIONE SI/NO <> SI",
    "DOPPIA CHANCE IN <> 1X",
    "DOPPIA CHANCE IN/OUT <> 12",
    "DOPPIA CHANCE OUT <> X2",
]

# Fixed values: (selection, complement) for markets with two outcomes.
TWO_WAY_COUNTERS = [
    ("1X2 <> 1", "DOPPIA CHANCE OUT <> X2"),
    ("1X2 <> X", "DOPPIA CHANCE IN/OUT <> 12"),
    ("1X2 <> 2", "DOPPIA CHANCE IN <> 1X"),
    ("DOPPIA CHANCE OUT <> X2", "1X2 <> 1"),
    ("DOPPIA CHANCE IN/OUT <> 12", "1X2 <> X"),
    ("DOPPIA CHANCE IN <> 1X", "1X2 <> 2"),
    ("U/O 0.5 <> OVER", "U/O 0.5 <> UNDER"),
    ("U/O 1.5 <> OVER", "U/O 1.5 <> UNDER"),
    ("U/O 2.5 <> OVER", "U/O 2.5 <> UNDER"),
    ("U/O 3.5 <> OVER", "U/O 3.5 <> UNDER"),
    ("U/O 4.5 <> OVER", "U/O 4.5 <> UNDER"),
    ("U/O 0.5 <> UNDER", "U/O 0.5 <> OVER"),
    ("U/O 1.5 <> UNDER", "U/O 1.5 <> OVER"),
    ("U/O 2.5 <> UNDER", "U/O 2.5 <> OVER"),
    ("U/O 3.5 <> UNDER", "U/O 3.5 <> OVER"),
    ("U/O 4.5 <> UNDER", "U/O 4.5 <> OVER"),
    ("GOAL/NOGOAL <> GOAL", "GOAL/NOGOAL <> NOGOAL"),
    ("GOAL/NOGOAL <> NOGOAL", "GOAL/NOGOAL <> GOAL"),
    ("ESPULSIONE SI/NO <> NO", "ESPULSIONE SI/NO <> SI"),
    ("ESPULSIONE SI/NO <> SI", "ESPULSIONE SI/NO <> NO"),
]

# Fixed values: (selection, complement 1, complement 2) for three outcomes.
THREE_WAY_COUNTERS = [
    ("1X2 <> 1", "1X2 <> 2", "1X2 <> X"),
    ("1X2 <> X", "1X2 <> 1", "1X2 <> 2"),
    ("1X2 <> 2", "1X2 <> X", "1X2 <> 1"),
]

# Fixed values: (label as the feed writes it, canonical label), by feed.
LABELS_888SPORT = [
    ("Esito Finale 1X2 <> 1", "1X2 <> 1"),
    ("Esito Finale 1X2 <> 2", "1X2 <> 2"),
    ("Esito Finale 1X2 <> X", "1X2 <> X"),
    ("Totale gol 0.5 <> Over", "U/O 0.5 <> OVER 0.5"),
    ("Totale gol 1.5 <> Over", "U/O 1.5 <> OVER 1.5"),
    ("Totale gol 2.5 <> Over", "U/O 2.5 <> OVER 2.5"),
    ("Totale gol 3.5 <> Over", "U/O 3.5 <> OVER 3.5"),
    ("Totale gol 4.5 <> Over", "U/O 4.5 <> OVER 4.5"),
    ("Totale gol 5.5 <> Over", "U/O 5.5 <> OVER 5.5"),
    ("Totale gol 6.5 <> Over", "U/O 6.5 <> OVER 6.5"),
    ("Totale gol 0.5 <> Under", "U/O 0.5 <> UNDER 0.5"),
    ("Totale gol 1.5 <> Under", "U/O 1.5 <> UNDER 1.5"),
    ("Totale gol 2.5 <> Under", "U/O 2.5 <> UNDER 2.5"),
    ("Totale gol 3.5 <> Under", "U/O 3.5 <> UNDER 3.5"),
    ("Totale gol 4.5 <> Under", "U/O 4.5 <> UNDER 4.5"),
    ("Totale gol 5.5 <> Under", "U/O 5.5 <> UNDER 5.5"),
    ("Totale gol 6.5 <> Under", "U/O 6.5 <> UNDER 6.5"),
    ("Entrambe le squadre a segno (Gol/No Gol) <> Si", "GOAL/NOGOAL <> GOAL"),
    ("Entrambe le squadre a segno (Gol/No Gol) <> No", "GOAL/NOGOAL <> NOGOAL"),
    ("Doppia Chance <> 1X", "DOPPIA CHANCE IN <> 1X"),
    ("Doppia Chance <> 12", "DOPPIA CHANCE IN/OUT <> 12"),
    ("Doppia Chance <> X2", "DOPPIA CHANCE OUT <> X2"),
]
LABELS_FLAT = [
    ("1X2 Finale <> 1", "1X2 <> 1"),
    ("1X2 Finale <> 2", "1X2 <> 2"),
    ("1X2 Finale <> X", "1X2 <> X"),
    ("U/O 0,5 <> Ov.0,5", "U/O 0.5 <> OVER 0.5"),
    ("U/O 1,5 <> Ov.1,5", "U/O 1.5 <> OVER 1.5"),
    ("U/O 2,5 <> Ov.2,5", "U/O 2.5 <> OVER 2.5"),
    ("U/O 3,5 <> Ov.3,5", "U/O 3.5 <> OVER 3.5"),
    ("U/O 4,5 <> Ov.4,5", "U/O 4.5 <> OVER 4.5"),
    ("U/O 5,5 <> Ov.5,5", "U/O 5.5 <> OVER 5.5"),
    ("U/O 0,5 <> Un.0,5", "U/O 0.5 <> UNDER 0.5"),
    ("U/O 1,5 <> Un.1,5", "U/O 1.5 <> UNDER 1.5"),
    ("U/O 2,5 <> Un.2,5", "U/O 2.5 <> UNDER 2.5"),
    ("U/O 3,5 <> Un.3,5", "U/O 3.5 <> UNDER 3.5"),
    ("U/O 4,5 <> Un.4,5", "U/O 4.5 <> UNDER 4.5"),
    ("U/O 5,5 <> Un.5,5", "U/O 5.5 <> UNDER 5.5"),
    ("GG/NG <> Goal", "GOAL/NOGOAL <> GOAL"),
    ("GG/NG <> No goal", "GOAL/NOGOAL <> NOGOAL"),
    ("Espulsi Si/No <> No Esp", "ESPULSIONE SI/NO <> NO"),
    ("Espulsi Si/No <> Si Esp", "ESPULSIONE SI/NO <> SI"),
    ("Doppia Chance <> 1X", "DOPPIA CHANCE IN <> 1X"),
    ("Doppia Chance <> 12", "DOPPIA CHANCE IN/OUT <> 12"),
    ("Doppia Chance <> X2", "DOPPIA CHANCE OUT <> X2"),
]
LABELS_NESTED = [
    ("U/O 0.5 <> OVER", "U/O 0.5 <> OVER 0.5"),
    ("U/O 1.5 <> OVER", "U/O 1.5 <> OVER 1.5"),
    ("U/O 2.5 <> OVER", "U/O 2.5 <> OVER 2.5"),
    ("U/O 3.5 <> OVER", "U/O 3.5 <> OVER 3.5"),
    ("U/O 4.5 <> OVER", "U/O 4.5 <> OVER 4.5"),
    ("U/O 5.5 <> OVER", "U/O 5.5 <> OVER 5.5"),
    ("U/O 0.5 <> UNDER", "U/O 0.5 <> UNDER 0.5"),
    ("U/O 1.5 <> UNDER", "U/O 1.5 <> UNDER 1.5"),
    ("U/O 2.5 <> UNDER", "U/O 2.5 <> UNDER 2.5"),
    ("U/O 3.5 <> UNDER", "U/O 3.5 <> UNDER 3.5"),
    ("U/O 4.5 <> UNDER", "U/O 4.5 <> UNDER 4.5"),
    ("U/O 5.5 <> UNDER", "U/O 5.5 <> UNDER 5.5"),
]
LABELS_SISAL = [
    ("1X2 ESITO FINALE <> 1", "1X2 <> 1"),
    ("1X2 ESITO FINALE <> 2", "1X2 <> 2"),
    ("1X2 ESITO FINALE <> X", "1X2 <> X"),
    ("U/O 0.5 <> OVER", "U/O 0.5 <> OVER 0.5"),
    ("U/O 1.5 <> OVER", "U/O 1.5 <> OVER 1.5"),
    ("U/O 2.5 <> OVER", "U/O 2.5 <> OVER 2.5"),
    ("U/O 3.5 <> OVER", "U/O 3.5 <> OVER 3.5"),
    ("U/O 4.5 <> OVER", "U/O 4.5 <> OVER 4.5"),
    ("U/O 5.5 <> OVER", "U/O 5.5 <> OVER 5.5"),
    ("U/O 0.5 <> UNDER", "U/O 0.5 <> UNDER 0.5"),
    ("U/O 1.5 <> UNDER", "U/O 1.5 <> UNDER 1.5"),
    ("U/O 2.5 <> UNDER", "U/O 2.5 <> UNDER 2.5"),
    ("U/O 3.5 <> UNDER", "U/O 3.5 <> UNDER 3.5"),
    ("U/O 4.5 <> UNDER", "U/O 4.5 <> UNDER 4.5"),
    ("U/O 5.5 <> UNDER", "U/O 5.5 <> UNDER 5.5"),
    ("GOAL/NOGOAL <> GOAL", "GOAL/NOGOAL <> GOAL"),
    ("GOAL/NOGOAL <> NOGOAL", "GOAL/NOGOAL <> NOGOAL"),
    ("DOPPIA CHANCE <> 1X", "DOPPIA CHANCE IN <> 1X"),
    ("DOPPIA CHANCE <> 12", "DOPPIA CHANCE IN/OUT <> 12"),
    ("DOPPIA CHANCE <> X2", "DOPPIA CHANCE OUT <> X2"),
]

# Which dictionary each bookmaker's labels go through.
LABELS = {
    "888Sport": LABELS_888SPORT,
    "AdmiralYes": LABELS_NESTED,
    "BetMan": LABELS_FLAT,
    "MerkurWin": LABELS_NESTED,
    "Sisal": LABELS_SISAL,
    "SportPesa": LABELS_FLAT,
}

# Market types holding one of these words are left out.
EXCLUDED_TYPE_WORDS = [
    "MARCATORE",
    "HANDICAP",
    "CARTELLINO",
    "CORNER 1",
    "HAND CORNER",
    "TEMPO X + U/O TEMPO Y",
    "MINUTO",
    "INTERVALLO",
]

# LIKE patterns of labels an analyst looks past (any case).
NOISE_PATTERNS = [
    "%vince almeno un tempo%",
    "%vince entrambi i tempi%",
    "%segna un gol in entrambi i tempi%",
    "%segna un gol su calcio di rigore%",
    "%Handicap%",
    "%Angoli%",
    "%Calcio di rigore assegnato%",
    "%Cartellini totali%",
    "%Gol totali - %",
    "%Marcatore%",
    "%turno%",
    "%Posizione finale%",
]

# Italian month abbreviations, January first.
ITALIAN_MONTHS = [
    "Gen", "Feb", "Mar", "Apr", "Mag", "Giu",
    "Lug", "Ago", "Set", "Ott", "Nov", "Dic",
]

# Text between the two sides in an event name, by feed.
EVENT_SPLITTERS = {
    "888Sport": " - ",
    "AdmiralYes": " - ",
    "BetMan": "-",
    "MarathonBet": " vs ",
    "MerkurWin": " - ",
    "Sisal": " - ",
    "SportPesa": "-",
}

# A tournament needs more events than this to be listed.
MIN_EVENTS = {"nested": 1, "offer": 10, "map": 1}

# Column widths of the quotes table.
QUOTE_WIDTHS = {
    "bookmaker": 20,
    "tournament": 80,
    "event": 120,
    "bet": 60,
    "betOdd": 8,
}

# Keys of the stored tables.
QUOTE_KEYS = ["bookmaker", "betRadarID", "event", "bet"]
STAGING_KEYS = ["bookmaker", "betRadarID", "bet"]
MATCH2_KEYS = ["betRadarID", "bookmaker1", "bet1", "bookmaker2", "bet2"]
MATCH3_KEYS = MATCH2_KEYS + ["bookmaker3", "bet3"]

# Fixed value: match rows this much older than the run are stale.
PURGE_GRACE_SECONDS = 2

# Goal lines of the corrected counter dictionary (our option, not the default).
CORRECTED_LINES = ["0.5", "1.5", "2.5", "3.5", "4.5", "5.5", "6.5"]
