"""Parameters of the queries over the driver's tables, whose samples lie hours apart."""

from cadentia.operators.segments import Rules

RULES = Rules(high=0.45, low=0.20, max_gap=43200.0, min_dur=3600.0, long=150000.0, split_gap=15000.0, split_low_factor=0.95, min_split=40000.0, eps=0.05, artefact=90000.0, tail_pieces=4, tail_first=60000.0)
GT_RULES = Rules(high=0.35, low=0.25, max_gap=30000.0, min_dur=3600.0)
LEAST_IOU = 0.3

#: JSON texts of rectangles, with places for their numbers (r and b: right and bottom): all encodings, as such and inside each other, and texts without a valid one.
BOX_FORMS = [
    '{"x":{x},"y":{y},"w":{w},"h":{h}}',
    '{"x":{x},"y":{y}.5,"width":"{w}","height":{h}}',
    '{"left":{x},"top":{y},"width":{w},"height":{h}}',
    '{"left":{x},"top":{y},"right":{r},"bottom":{b}}',
    '{"l":{x},"t":{y},"r":{r},"b":{b}}',
    '{"x1":{x},"y1":{y},"x2":{r},"y2":{b}}',
    "[{x},{y},{w},{h}]",
    "[{r},{b},-{w},-{h}]",
    '{"points":[[{x},{y}],[{r},{y}],["none",7],{"x":{r},"y":{b}}]}',
    '{"polygon":[[{x},{y}]],"vertices":[{"x":{x},"y":{y}},{"x":{r},"y":{b}}]}',
    '{"bbox":{"x1":{x},"y1":{y},"x2":{r},"y2":{b}}}',
    '{"roi":{"note":"n","table":{"rect":[{x},{y},{w},{h}]}}}',
    '{"z":[{x},{y},{w},{h}],"a":[1,1,1,1]}',
    '{"a":{"b":{"c":{"d":{"poly":[[{x},{y}],[{r},{b}]]}}}},"e":[1,1,1,1]}',
    '{"x":{x},"y":{y},"w":-{w},"h":{h},"roi":[1,1,1,1]}',
    '{"x":null,"y":{y},"w":{w},"h":{h},"roi":[1,1,1,1]}',
    '{"roi":{"x":{x},"y":{y},"w":0,"h":{h},"bbox":[1,1,1,1]},"crop":[{x},{y},{w},{h}]}',
    '{"meta":{"w":{w}},"names":["a","b","c","d"],"text":"[{x},{y},{w},{h}]"}',
    "not json",
]

#: JSON texts of points' corrections, with places for an order's key and status.
CORRECTION_FORMS = [
    '[{"at":"2024-01-{day}","by":"ref","changes":{"winner":{"from":"unknown","to":"{status}"},"confidence":{"to":0.5}},"note":"n {key}"}]',
    '[{"changes":{"t_end":{"from":{key},"to":{key}.5}}},{"by":"second","changes":{"flags":["a","{status}"],"id":null}}]',
    '[{"at":"x","by":"y","changes":{}}]',
    "[]",
]
