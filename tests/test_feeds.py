"""Game feeds and box scores, on a small feed."""

import json

from tidewheel.sources import feeds


def pitch(i, balls, strikes, pitcher=9, **more):
    return {"index": i, "isPitch": True, "type": "pitch", "details": {"call": {"code": "B"}}, "count": {"balls": balls, "strikes": strikes, "outs": 1}, "defense": {"pitcher": {"id": pitcher}}, "offense": {"first": {"id": 5}}, **more}


def play(n, events, event="Single", home=0, away=0, half="top"):
    return {"atBatIndex": n, "about": {"inning": 1, "halfInning": half}, "matchup": {"pitcher": {"id": 8}, "batter": {"id": 4}}, "result": {"event": event, "homeScore": home, "awayScore": away}, "playEvents": events}


GAME = {"gamePk": 77, "liveData": {"plays": {"allPlays": [
    play(0, [pitch(0, 0, 0), {"index": 1, "type": "pickoff", "details": {}, "base": 1, "offense": {"first": {"id": 5}, "third": {"id": 6}}}, {"index": 2, "type": "action", "details": {"eventType": "pitching_substitution"}, "player": {"id": 8}}, pitch(3, 1, 0, 8)], away=2),
    play(1, [{"index": 0, "type": "action", "details": {"eventType": "stolen_base_2b", "isOut": False}}, {"index": 1, "type": "action", "details": {"eventType": "game_advisory"}}, pitch(2, 0, 0, 8)], away=2),
    play(2, None, "Intent Walk", away=2),
]}}}


def test_game_feed(spark):
    df = spark.createDataFrame([(1, json.dumps(GAME), "clash"), (2, "no feed", "x"), (3, None, "x"), (4, json.dumps({"gamePk": 1}), "x")], "fetch int, payload string, inning string")
    p = feeds.pitches(df, "payload", ["fetch"]).orderBy("at_bat_number", "pitch_number").collect()
    assert [(r.fetch, r.game_pk, r.at_bat_number, r.pitch_number, r.pitcher_id, r.balls, r.runners_state, r.score_diff, r.event) for r in p] == [(1, 77, 1, 1, 9, 0, 1, 0, None), (1, 77, 1, 2, 8, 1, 1, 0, "Single"), (1, 77, 2, 1, 8, 0, 1, 2, "Single")]
    e = feeds.play_events(df, "payload").orderBy("at_bat_number", "play_index").collect()
    assert [(r.at_bat_number, r.play_index, r.event_type, r.runners_state, r.base, r.pitcher_id) for r in e] == [(1, 1, "pickoff_throw", 5, 1, 9), (1, 2, "pitching_change", None, None, 8), (2, 0, "steal", None, None, 8), (3, -1, "intentional_walk", 1, None, 8)]
    assert feeds.pitches(df.limit(0), "payload").count() == 0


def test_box_scores(spark):
    player = lambda i, bat, arm, order=None: {"person": {"id": i}, "position": {"abbreviation": "CF"}, "battingOrder": order, "stats": {"batting": bat, "pitching": arm}}
    box = {"home": {"team": {"id": 3}, "players": {"ID1": player(1, {"gamesPlayed": 1, "hits": 2}, {}, "100"), "ID2": player(2, {}, {}), "ID4": player(None, {"hits": 1}, {})}}, "away": {"team": {}, "players": {"ID3": player(3, {"hits": 1}, {})}}}
    rows = feeds.box_scores(spark.createDataFrame([(7, json.dumps(box)), (8, "[")], "game_pk int, payload string"), "payload", ["game_pk"]).collect()
    assert [(r.game_pk, r.side, r.team_id, r.player_id, r.batting_order, r.position, r.played_bat, r.played_pitch, r.b_hits, r.p_outs) for r in rows] == [(7, "home", 3, 1, 100, "CF", True, False, 2, 0)]
