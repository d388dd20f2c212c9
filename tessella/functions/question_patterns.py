"""Fixed values for classes of questions. Phrases, patterns and word lists, and their order (the first that fits
decides), have to equal those that the published labels were made with.
"""

# Phrases, nouns and patterns of question classes; of each list the first that fits wins.
PHRASES = [("want to do next", "wants"), ("need to do before", "needs"), ("how would you describe", "descriptions"), ("feel", "reactions"), ("why did", "motivations"), ("what will happen", "effects")]
RELATIONS = (
    "brother|sister|mother|father|mom|dad|mum|parents|family|husband|wife|boss|friend|neighbor|children|son|daughter|girlfriend|boyfriend|"
    "teacher|nurse|doctor|coach|waitress|landlord|bully|director|uncle|aunt|grandmother|grandfather|partner|person"
)
GROUPS = (
    "friends|students|coworkers|colleagues|classmates|teammates|neighbors|cops|police|spectators|pedestrians|customers|employees|"
    "bystanders|opponents|siblings|managers|tutors|girls|women|kids|children|parents|members|congregation|audience|family"
)
OTHERS = [
    ("oReact", r"\bothers?\b.*\bfeel\b"),
    ("oReact", r"\bfeel\b.*\bothers?\b"),
    ("oReact", r"\bothers?\b.*\b(?:think|say|observe|respond|react)\b"),
    ("oReact", r"\bmake others feel\b"),
    ("oWant", r"\bothers?\b.*\b(?:want|do|going to do)\b"),
    ("oEffect", r"\b(?:happen|result|effect)\b.*\bothers?\b"),
    ("oReact", r"\b(?:someone|everyone)\b.*\bfeel\b"),
    ("oWant", r"\b(?:someone|everyone)\b.*\b(?:want|do)\b"),
    ("oReact", rf"\b(?:his|her|their|the)\s+(?:{RELATIONS})\b.*\bfeel\b"),
    ("oReact", rf"\b\w+'s\s+(?:{RELATIONS})\b.*\bfeel\b"),
    ("oWant", rf"\b(?:his|her|their|the)\s+(?:{RELATIONS})\b.*\b(?:want|do)\b"),
    ("oWant", rf"\b\w+'s\s+(?:{RELATIONS})\b.*\b(?:want|do)\b"),
    ("oEffect", rf"\b(?:happen|result|effect)\b.*\b(?:his|her|their|the)\s+(?:{RELATIONS})\b"),
    ("oEffect", rf"\b(?:happen|result|effect)\b.*\b\w+'s\s+(?:{RELATIONS})\b"),
    ("oReact", rf"\b(?:{GROUPS})\b.*\bfeel\b"),
    ("oWant", rf"\b(?:{GROUPS})\b.*\b(?:want|do)\b"),
    ("oEffect", rf"\b(?:happen|result|effect)\b.*\b(?:{GROUPS})\b"),
]
SELF = [
    ("xReact", r"\bhow\b.*\bfeel\b"),
    ("xReact", r"\bwhat\b.*\b\w+\b\s+feel\b"),
    ("xReact", r"\bfeel\s+(?:how|what)\b"),
    ("xReact", r"\bfeeling\s+afterwards\b"),
    ("xReact", r"\bhow will \w+ react\b"),
    ("xReact", r"\bhow will \w+ respond\b"),
    ("xAttr", r"\bhow\b.*\b(?:describ\w*|seen|perceived)\b"),
    ("xAttr", r"\bcould be described\b"),
    ("xAttr", r"\bwhat kind of person\b"),
    ("xAttr", r"\bis \w+ \w+ or \w+\?"),
    ("xIntent", r"\bwhy\b.*\b(?:did|do|does|would|is)\b"),
    ("xIntent", r"\bwhat (?:made|led|caused)\b"),
    ("xIntent", r"\bbecause\??\s*$"),
    ("xWant", r"\bwhat\b.*\bwant\b"),
    ("xNeed", r"\bwhat\b.*\bneed\b.*\bbefore\b"),
    ("xNeed", r"\bbefore\b.*\bwhat\b.*\b(?:did|do|have to)\b"),
    ("xNeed", r"\bwhat\b.*\bbefore\b"),
    ("xNeed", r"\bshould\b.*\bbefore\b"),
    ("xWant", r"\bwhat will \w+ do (?:next|after)\b"),
    ("xWant", r"\bwhat (?:will|would|does|is|are|should|may|can)\b.*\bdo\b"),
    ("xWant", r"\bcourse of action\b"),
    ("xWant", r"\bgoing to do\b"),
    ("xWant", r"\blikely to do\b"),
    ("xEffect", r"\bwhat\b.*\b(?:happen|result|effect)\b"),
    ("xEffect", r"\bwhat did \w+ (?:do|say|create)\b"),
]
OTHER_OF = {"xReact": "oReact", "xWant": "oWant", "xEffect": "oEffect"}

# Where the subject of a question stands, by its class.
SUBJECTS = {
    "xReact": [r"\bhow (?:would|will|does|might) (\w+)\b", r"\bwhat (?:would|will) (\w+) feel\b", r"\bhow will (\w+) (?:react|respond)\b"],
    "xWant": [r"\bwhat (?:will|would|does) (\w+) (?:want|do)\b", r"\bwhat will (\w+) (?:likely |probably )?do\b", r"\bwill (\w+) (?:want|do)\b"],
    "xEffect": [r"\bhappen(?:s|ed)? to (\w+)\b"],
}
