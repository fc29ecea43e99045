"""Record schemas. States, actions and players are parameters; the defaults are the board layout."""

SCHEMA_VERSION = 1

STATE = "STRUCT<cells: ARRAY<STRING>, to_move: STRING>"


def sequences(state=STATE, action="INT"):
    return (
        "schema_version INT, run_id STRING, game_id STRING, "
        "cell STRUCT<index: BIGINT, strategies: ARRAY<STRING>, evaluator: STRING, opening: STRING, "
        "random_opening_plies: INT>, game_index BIGINT, seed DECIMAL(20,0), players ARRAY<STRING>, "
        f"opening_plies BIGINT, actions ARRAY<{action}>, outcome STRING, length BIGINT, "
        f"final_state {state}, final_canonical_state {state}"
    )


def steps(state=STATE, action="INT"):
    return (
        f"schema_version INT, game_id STRING, ply BIGINT, side_to_move STRING, state {state}, "
        f"canonical_state {state}, canonical_transform ARRAY<INT>, legal_actions ARRAY<{action}>, "
        f"chosen_action {action}, chosen_by STRING, outcome STRING, game_length BIGINT"
    )


def annotations(state=STATE, action="INT"):
    return (
        f"schema_version INT, state {state}, canonical_state {state}, side_to_move STRING, terminal BOOLEAN, "
        f"value TINYINT, optimal_actions ARRAY<{action}>, engine_action {action}, engine_agrees BOOLEAN"
    )


def dataset(state=STATE):
    return (
        f"schema_version INT, canonical_state {state}, side_to_move INT, value TINYINT, occurrences BIGINT, "
        "legal ARRAY<INT>, optimal ARRAY<INT>, qualifying ARRAY<STRING>, label STRING, values ARRAY<DOUBLE>"
    )


RUN = (
    "schema_version INT, run_id STRING, game STRING, sequences BIGINT, steps BIGINT"
)

ANNOTATION_SET = "schema_version INT, run_id STRING, game STRING, mode STRING, rows BIGINT"

COMMIT = "schema_version INT, run_id STRING, game STRING, output STRING, fields STRING, rows BIGINT, digest DECIMAL(38,0)"

OUTPUT = "schema_version INT, run_id STRING, output STRING, rows BIGINT"

CONTESTS = (
    "candidate STRING, opponent STRING, seat INT, game_index BIGINT, player STRING, winner STRING, "
    "finished BOOLEAN, plies BIGINT"
)

PROVENANCE = (
    "STRUCT<game: STRING, source: STRING, evaluation_id: STRING, roster_id: STRING, seed: DECIMAL(20,0), "
    "corpus_run_id: STRING, annotations_mode: STRING, experiment: STRING, config_hash: STRING, miner: STRING, "
    "max_depth: INT, min_leaf: INT, mine_seed: DECIMAL(20,0), holdout_fraction: DOUBLE, candidate: STRING>"
)

ARCHIVE = (
    "schema_version INT, game STRING, entry_id STRING, sequence BIGINT, name STRING, kind STRING, depth INT, "
    f"epsilon DOUBLE, tie_break STRING, rules ARRAY<STRING>, provenance {PROVENANCE}, sample_id STRING, "
    "signature ARRAY<STRING>, nearest_sequence BIGINT, spec_distance DOUBLE, behaviour_distance DOUBLE, "
    "distance DOUBLE, is_novel BOOLEAN"
)
