"""Fixed schemas and fixed values the engine must reproduce (all in one place)."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: track file columns, in file order -----------------------
TRACK_COLUMNS = [
    ("artist", T.StringType()),
    ("song", T.StringType()),
    ("duration_ms", T.IntegerType()),
    ("explicit", T.BooleanType()),
    ("year", T.IntegerType()),
    ("popularity", T.IntegerType()),
    ("danceability", T.DoubleType()),
    ("energy", T.DoubleType()),
    ("key", T.IntegerType()),
    ("loudness", T.DoubleType()),
    ("mode", T.IntegerType()),
    ("speechiness", T.DoubleType()),
    ("acousticness", T.DoubleType()),
    ("instrumentalness", T.DoubleType()),
    ("liveness", T.DoubleType()),
    ("valence", T.DoubleType()),
    ("tempo", T.DoubleType()),
    ("genre", T.StringType()),
]

# Older files name key/mode feature1/feature2.
LEGACY_ALIASES = {"feature1": "key", "feature2": "mode"}

# --- fixed values: text tokens pandas reads as missing ---------------------
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]

# --- fixed values: feature lists -------------------------------------------
# recommender features (min-max scaled, missing -> 0)
RECOMMENDER_FEATURES = ["danceability", "energy", "loudness", "speechiness",
                        "acousticness", "instrumentalness", "liveness", "valence",
                        "tempo", "popularity"]
# similar-songs numeric features (standard scaled) + one-hot genre
SIMILAR_FEATURES = ["duration_ms", "year", "energy", "loudness"]
# popularity regressor inputs
SCORING_FEATURES = ["duration_ms", "year", "energy", "loudness", "genre"]
SCORING_KEY = ["song", "duration_ms", "year"]
# columns a file needs to be scored
SCORING_INPUT = ["song", "duration_ms", "year", "energy", "loudness", "genre"]

# --- fixed values: prediction kinds and sources ----------------------------
PREDICTION_KINDS = ["single", "similar", "multiple"]
SOURCES = ["WEBAPP", "SCHEDULED"]


# --- fixed values: quality error classes and the severity scale ------------
ERROR_CLASSES = ["missing_values", "invalid_types", "out_of_range",
                 "invalid_format", "other_errors"]
KIND_CLASS = {"not_null": "missing_values", "of_type": "invalid_types",
              "between": "out_of_range", "not_match": "invalid_format"}
SEVERITY_HIGH_ABOVE = 0.7
SEVERITY_MEDIUM_ABOVE = 0.3
SEVERITY_COLOURS = {"HIGH": "FF0000", "MEDIUM": "FFA500", "LOW": "0076D7"}
ALERT_TITLE = "DATA QUALITY ALERT - %s CRITICALITY"
FILE_OUTCOMES = ["ok", "empty_file", "file_read_error", "validation_error",
                 "critical_error"]

# --- fixed values: result and outcome texts --------------------------------
TEMPLATE_SINGLE = "Predicted for %s with %s danceability and %s tempo"
NOT_FOUND = "Song not found"
NO_INPUT = "Please provide artist or song name"
NO_MATCH = "No matching songs found"

# --- fixed values: category text that stands for an empty list -------------
EMPTY_CATEGORY_TOKENS = ["set()"]

# --- fixed values: "no filter" words and paging limits ---------------------
ALL_WORDS = ("all",)          # category filter: any case
SOURCE_ALL = ("ALL", "all")   # source filter: these two spellings
PAGE_LIMIT_RANGE = (1, 100)

# --- fixed values: stored columns per prediction kind ----------------------
KIND_COLUMNS = {
    "single": ["id", "song", "duration_ms", "year", "energy", "loudness", "genre",
               "predicted_popularity", "source", "created_at"],
    "similar": ["id", "reference_song", "reference_artist", "similar_songs", "source", "created_at"],
    "multiple": ["id", "batch_data", "source", "created_at"],
}

# --- fixed values: synthetic generator vocabularies and ranges -------------
FULL_GENRES = ["Pop", "Rock", "Hip Hop", "Electronic", "R&B", "Country", "Jazz",
               "Classical", "Folk", "Reggae"]
SMALL_GENRES = ["pop", "rock", "jazz", "hip-hop", "classical"]
FULL_ARTISTS = 20      # Artist_1 .. Artist_20
FULL_SONGS = 100       # Song_1 .. Song_100


def track_schema(all_strings: bool = False, corrupt_col: str | None = None) -> T.StructType:
    """The 18-column track schema; ``all_strings`` reads raw text for checks."""
    fields = [T.StructField(n, T.StringType() if all_strings else t, True)
              for n, t in TRACK_COLUMNS]
    if corrupt_col:
        fields.append(T.StructField(corrupt_col, T.StringType(), True))
    return T.StructType(fields)


def track_suite():
    """The 13-rule expectation suite over the raw (string) track columns."""
    from cadenza.operators.quality import Expectation as E
    return [
        E("not_null", "artist"),
        E("not_null", "song"),
        E("of_type", "duration_ms", ("int",)),
        E("between", "year", (1900, 2023)),
        E("between", "popularity", (0, 100)),
        E("between", "danceability", (0.0, 1.0)),
        E("between", "energy", (0.0, 1.0)),
        E("between", "loudness", (-60.0, 0.0)),
        E("between", "speechiness", (0.0, 1.0)),
        E("between", "tempo", (0.0, 300.0)),
        E("of_type", "genre", ("str",)),
        E("not_match", "duration_ms", ("[a-zA-Z]",)),
        E("not_match", "year", ("[a-zA-Z]",)),
    ]
