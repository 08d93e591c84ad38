"""Rules in the language of the test texts, so that every branch is reached."""

from __future__ import annotations

from sectorpulse.operators.score import Lexicon
from sectorpulse.rules.tables import RuleSet, Sector

LEXICON = Lexicon(
    positive={"thble": 1.0, "étion": 1.5, "Nicht": 1.0, "ciónll": 1.5, "hable": 1.0},
    negative={"reing": 1.0, "aiment": 1.5, "enung": 1.0, "esción": 1.5, "ention": 1.0},
    words={
        "high": ["ortion", "ouelle", "einer", "ciónrr"],
        "medium": ["ingre", "mentoi", "erach", "ciónquedo"],
        "policy": ["whtion", "èelle", "ungsch", "asado"],
        "industry": ["eation", "queeux", "chein", "raado"],
        "stock_move": ["theaeati", "queeau", "einst", "doque"],
    },
    macro=[
        ("m1", ["ingre", "étion"], ["thble", "ouelle"], [("en", "positive", "r1"), ("fr", "negative", "r2")]),
        ("m2", ["thanea", "nicht"], [], [("en", "negative", "r3"), ("de", "positive", "r4"), ("fr", "neutral", "r6")]),
        ("m3", ["ciónmente"], ["asado", "ciónll"], [("es", "negative", "r5")]),
    ],
)

EVENTS = RuleSet.of(
    {
        "cat_en": [
            (["thanea", "thther"], ["thble", "reing"], ["thhewh"], 1.0, 1.0),
            (["hable", "thatou", "blean"], [], [], 1.0, 2.0),
            (["Whtion"], [], [], 2.0, 2.0),
        ],
        "cat_fr": [
            (["étion", "aiment"], [], ["queeux"], 1.0, 1.0),
            (["ouelle"], ["mentré", "aneau"], [], 1.0, 1.0),
        ],
        "cat_de": [(["nicht"], ["enung"], ["einst"], 1.0, 1.0), (["chein"], [], [], 2.0, 2.0)],
    }
)
# 'en' is held to a stricter family, 'de' names an id nobody knows, the others have none.
FAMILIES = RuleSet.of({"苹果产业链": [(["thble"], [], ["thhewh"], 1.0, 1.0), (["ingre"], ["reing"], [], 2.0, 2.0)]})
SECTORS = [
    Sector("en", ["thble", "ingre", "hable"], "apple_supply_chain"),
    Sector("fr", ["étion", "Ouelle"]),
    Sector("de", ["nicht", "chein"], "unknown_rule"),
    Sector("es", ["ciónmente"]),
]
MAPPING = {"cat_en": ["en", "fr"], "cat_fr": ["fr"], "cat_de": []}
KEYWORDS = ["thble", "Ingre", "étion", "OUELLE", "nicht", "chein", "ciónmente", "hable", "ß"]
