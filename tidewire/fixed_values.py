"""Fixed values.

These lists and constants define the measurement: two engines agree only if they
hold the same entries. They are stated plainly and carry no logic.
"""

# --- Fixed values: publisher register ----------------------------------------

RU_STATE = [
    "tass.ru", "special.tass.ru", "ria.ru", "rg.ru", "rt.com", "riafan.ru", "vesti.ru", "iz.ru",
    "vz.ru", "life.ru", "1tv.ru", "tvzvezda.ru", "smotrim.ru", "sputniknews.com", "ren.tv",
    "1prime.ru", "mskagency.ru", "aif.ru", "kp.ru", "pda.kp.ru", "vm.ru", "regnum.ru", "lenta.ru",
    "gazeta.ru", "ura.news", "russian.rt.com", "inosmi.ru", "rueconomics.ru",
]

RU_INDEP = [
    "meduza.io", "novayagazeta.eu", "novayagazeta.ru", "theins.ru", "zona.media", "mediazona.ca",
    "moscowtimes.ru", "themoscowtimes.com", "republic.ru", "tvrain.ru", "echo.msk.ru",
    "kommersant.ru", "vedomosti.ru", "rbc.ru", "znak.com", "7x7-journal.ru",
]

UA_DOMAINS = [
    "unian.net", "censor.net", "pravda.com.ua", "ukrinform.net", "kyivindependent.com",
    "kyivpost.com", "epravda.com.ua", "hromadske.ua", "liga.net", "obozrevatel.com",
    "korrespondent.net", "strana.news",
]

WEST_DOMAINS = [
    "reuters.com", "bloomberg.com", "ft.com", "wsj.com", "nytimes.com", "washingtonpost.com",
    "cnn.com", "bbc.co.uk", "bbc.com", "theguardian.com", "telegraph.co.uk", "economist.com",
    "apnews.com", "cnbc.com", "politico.eu", "spiegel.de", "lemonde.fr", "faz.net",
    "handelsblatt.com", "marketwatch.com", "barrons.com", "forbes.com", "businessinsider.com",
    "axios.com", "npr.org", "dw.com", "svoboda.org", "currenttime.tv",
]

AGGREGATORS = [
    "msn.com", "yahoo.com", "news.yahoo.com", "news.google.com", "iheart.com", "finance.yahoo.com",
    "news.mail.ru", "news.meta.ua", "flipboard.com", "newsbreak.com", "smartnews.com",
]

WEST_TLDS = [
    "us", "uk", "de", "fr", "it", "es", "pl", "nl", "se", "no", "dk", "fi", "ca", "au", "be", "at",
    "cz", "pt", "ie", "gr", "ro", "hu", "sk", "si", "lt", "lv", "ee", "bg", "hr", "lu", "is", "nz",
    "ch",
]

CORE_LABELS = ["UA", "RU_STATE", "RU_INDEP", "WEST", "EN_GLOBAL"]
LOCAL_LABELS = ["UA", "RU_STATE", "RU_INDEP"]
WESTERN_LABELS = ["WEST", "EN_GLOBAL"]

# The country each label asserts, and which labels an audit may check.
LABEL_COUNTRY = {
    "UA": "UA", "RU_STATE": "RU", "RU_INDEP": "RU", "RU_OTHER": "RU", "WEST": "WEST",
}

# --- Fixed values: conflict markers and theme codes ---------------------------

CONFLICT_MARKS = ["#UP#", "#RS#"]

ACT_THEMES = [
    "KILL", "WOUND", "CRISISLEX_T03_DEAD", "CRISISLEX_T02_INJURED", "ARMEDCONFLICT", "TERROR",
    "SIEGE", "REBELLION", "MANMADE_DISASTER_IMPLIED",
]

THREAT_THEMES = [
    "THREATEN", "MILITARY", "TAX_WEAPONS", "TAX_FNCACT_TROOPS", "BORDER", "NUCLEAR", "SANCTIONS",
    "EPU_CATS_NATIONAL_SECURITY", "USPEC_UNCERTAINTY1", "SECURITY_SERVICES",
]

# --- Fixed values: hosts that are not news ------------------------------------

INTERNAL_HOSTS = [
    "facebook.com", "twitter.com", "x.com", "youtube.com", "tiktok.com", "instagram.com",
    "linkedin.com", "reddit.com", "medium.com", "wordpress.com", "blogspot.com", "tumblr.com",
    "vk.com", "ok.ru", "telegram.me", "t.me",
]

# --- Fixed values: country code groups ----------------------------------------

COUNTRY_GROUPS = {
    "ukrainian": ["UA", "UP"],
    "russian": ["RU", "RS"],
    "western": [
        "US", "GB", "UK", "CA", "AU", "AS", "NZ", "DE", "GM", "FR", "IT", "ES", "NL", "BE", "LU",
        "AT", "IE", "EI", "DK", "FI", "SE", "PT", "GR", "CZ", "HU", "PL", "RO", "BG", "HR", "SK",
        "SI", "LT", "LV", "EE", "CY", "MT", "CH", "NO", "LI", "MC", "JP", "JA", "KR", "KS", "TW",
        "IL", "IS",
    ],
}

# --- Fixed values: knowledge-base country items --------------------------------

DEFUNCT_COUNTRIES = ["Q15180", "Q34266", "Q2305208"]

COUNTRY_ITEMS = {
    "RU": ["Q159", "Q15180", "Q34266"],
    "UA": ["Q212", "Q2305208"],
    "WEST": [
        "Q30", "Q145", "Q183", "Q142", "Q38", "Q29", "Q36", "Q55", "Q34", "Q20", "Q35", "Q33",
        "Q16", "Q408", "Q31", "Q40", "Q213", "Q45", "Q27", "Q41", "Q218", "Q28", "Q214", "Q219",
        "Q224", "Q211", "Q37", "Q191", "Q32", "Q189", "Q39", "Q664",
    ],
}

STATE_OWNER_WORDS = [
    "government", "state", "ministry", "federal", "russian federation", "presidential",
]

# --- Fixed values: legal suffixes, in the order they are stripped ---------------

LEGAL_SUFFIXES = [
    " corp.", " corporation", " co.", " inc.", " plc", " ltd", " group", " company",
    " sa", " spa", " ab", " asa", " se",
]

# --- Fixed values: rate series names ---------------------------------------------

RATE_NAMES = {
    "VIXCLS": "vix", "DCOILBRENTEU": "brent", "DEXUSEU": "usd_eur", "DGS10": "ust10y",
    "DTWEXBGS": "usd_broad",
}

# --- Fixed values: calendar ---------------------------------------------------------

SAMPLE_START = "2015-02-18"
BUILDUP_START = "2021-11-01"
INVASION_DATE = "2022-02-24"
COUNTS_START = "2022-09-29"
REGIMES = ["pre_war", "buildup", "invasion", "attrition"]

GRID_WINDOWS = {
    "Russia buildup+invasion": ("2021-11-22", "2022-03-22"),
    "all ingested days": None,
    "2017-19 episodes": ("2017-04-23", "2019-10-21"),
    "2025-26 episodes": ("2025-03-07", "2026-05-20"),
}

# Named spans: target table, kind of daily table, and the ranges to read.
SPAN_PRESETS = {
    "full": ("daily_labels", "ecosystem", [
        ("2015-02-18", "2015-12-31"), ("2016-01-01", "2016-12-31"),
        ("2017-01-01", "2017-04-22"), ("2017-04-23", "2019-10-21"),
        ("2021-06-01", "2021-09-07"), ("2021-09-08", "2022-06-05"),
        ("2022-06-06", "2022-12-31"), ("2023-01-01", "2023-12-31"),
        ("2025-03-07", "2026-05-20"),
    ]),
    "holdout": ("daily_labels_holdout", "ecosystem", [
        ("2019-10-22", "2020-06-30"), ("2020-07-01", "2021-05-31"),
        ("2024-01-01", "2024-12-31"),
    ]),
    "threat-act": ("threat_act", "threat_act", [
        ("2017-04-23", "2018-02-28"), ("2018-03-01", "2018-12-31"),
        ("2019-01-01", "2019-10-21"), ("2021-09-08", "2022-06-05"),
        ("2025-03-07", "2026-05-20"),
    ]),
    "threat-act-fill": ("threat_act", "threat_act", [
        ("2015-02-18", "2015-12-31"), ("2016-01-01", "2016-08-31"),
        ("2016-09-01", "2017-04-22"), ("2019-10-22", "2020-08-31"),
        ("2020-09-01", "2021-09-07"), ("2022-06-06", "2023-06-30"),
        ("2023-07-01", "2024-12-31"),
    ]),
}

KNOWN_EVENTS = {
    "Russia buildup / invasion": "2022-02-01",
    "Crimea aftermath / Minsk II": "2015-02-12",
    "North Korea ICBM crisis": "2017-08-10",
    "Soleimani strike": "2020-01-03",
    "Russia spring buildup": "2021-04-15",
    "Israel-Iran exchange": "2024-04-14",
}

# --- Fixed values: thresholds set in advance --------------------------------------------

MATCH_THRESHOLDS = {
    "return_corr_min": 0.95, "vol_corr_min": 0.90, "beta_low": 0.85, "beta_high": 1.15,
    "r2_min": 0.90, "tracking_error_max": 0.50,
}

MEASUREMENT_GATE = {
    "west_risk_corr_min": 0.40, "max_pairwise_corr": 0.70, "min_daily_articles": 50,
    "event_zscore_min": 2.0,
}

WEAPON_CLASSES = [
    "ballistic_missile", "cruise_missile", "loitering_munition", "uav", "recon_uav",
    "guided_bomb", "other",
]

PREDICTED_SIGNS = {
    "act_UA": -1, "thr_UA": 1, "act_RU_STATE": -1, "act_RU_INDEP": 1,
}
