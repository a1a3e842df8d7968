"""Vocabulary of the reasoning text.  All values in this module are fixed values."""

REASON_START = "<reason_start>"
REASON_END = "<reason_end>"
TRAJ_START = "<traj_start>"
TRAJ_END = "<traj_end>"

# surface phrase -> decision it claims
DECISION_PHRASES = {
    "approach": "approach", "approaching": "approach", "drive forward": "approach",
    "align": "align", "aligning": "align", "line up": "align", "lining up": "align",
    "creep": "creep", "creeping": "creep", "crawl": "creep", "crawling": "creep",
    "reverse": "reverse", "reversing": "reverse", "back": "reverse", "backing": "reverse",
    "stop": "stop_yield", "yield": "stop_yield", "halt": "stop_yield",
    "yielding": "stop_yield", "stopping": "stop_yield",
    "shift": "shift_gear", "gear": "shift_gear", "change gear": "shift_gear",
    "shifting": "shift_gear",
    "parked": "complete_park", "finish": "complete_park", "complete": "complete_park",
    "completed": "complete_park", "completing": "complete_park",
    "abort": "abort", "aborting": "abort",
}

# surface word -> obstacle class
OBSTACLE_WORDS = {
    "car": "car", "vehicle": "car", "sedan": "car",
    "truck": "truck", "van": "truck", "lorry": "truck",
    "pedestrian": "pedestrian", "person": "pedestrian", "walker": "pedestrian",
}
SLOT_WORDS = ["slot", "bay", "space", "spot", "parking"]

# decision -> smaller decisions it contains
SUBSUMED = {"complete_park": ["align"], "reverse": ["align"]}

DECISION_HEAD = {
    "approach": "I am approaching my goal",
    "align": "I am aligning my heading",
    "creep": "I am creeping forward slowly",
    "reverse": "I am reversing",
    "stop_yield": "I am stopping to yield",
    "shift_gear": "I am shifting gears",
    "complete_park": "I have completed the park",
    "abort": "I am aborting the maneuver",
}

MANNER_TEXT = {
    "tight_turn": "this needs a tight turn",
    "gentle_turn": "only a gentle steering correction is needed",
    "setup_forward": "I am pulling forward first to set up my angle for the slot",
    "short_adjust": "this is only a short final adjustment",
    "closer_left": "the nearer of the two cars is on my left",
    "closer_right": "the nearer of the two cars is on my right",
}

TEACHER_CLOSING = (
    "Speak strictly in the first person (I, my). Never call yourself 'the car' or "
    "'the vehicle' — the guard reads those words as obstacle mentions.\n"
    "Write the reasoning:"
)
