"""Fixed values of the data model: keypoints, angles, bands, thresholds."""

# Keypoint names in index order.
KEYPOINTS = [
    "NOSE",
    "LEFT_EAR",
    "RIGHT_EAR",
    "BASE_NECK",
    "LEFT_FRONT_PAW",
    "RIGHT_FRONT_PAW",
    "CENTER_SPINE",
    "LEFT_REAR_PAW",
    "RIGHT_REAR_PAW",
    "BASE_TAIL",
    "MID_TAIL",
    "TIP_TAIL",
]
NUM_KEYPOINTS = len(KEYPOINTS)
INDEX = {name: position for position, name in enumerate(KEYPOINTS)}
BODY = KEYPOINTS[:10]  # hull and presence use the body, not mid and tip of the tail

# The named angles as (end, vertex, end).
ANGLES = [
    ("NOSE", "BASE_NECK", "RIGHT_FRONT_PAW"),
    ("NOSE", "BASE_NECK", "LEFT_FRONT_PAW"),
    ("RIGHT_FRONT_PAW", "BASE_NECK", "CENTER_SPINE"),
    ("LEFT_FRONT_PAW", "BASE_NECK", "CENTER_SPINE"),
    ("BASE_NECK", "CENTER_SPINE", "BASE_TAIL"),
    ("RIGHT_REAR_PAW", "BASE_TAIL", "CENTER_SPINE"),
    ("LEFT_REAR_PAW", "BASE_TAIL", "CENTER_SPINE"),
    ("RIGHT_REAR_PAW", "BASE_TAIL", "MID_TAIL"),
    ("LEFT_REAR_PAW", "BASE_TAIL", "MID_TAIL"),
    ("CENTER_SPINE", "BASE_TAIL", "MID_TAIL"),
    ("BASE_TAIL", "MID_TAIL", "TIP_TAIL"),
]

# Keypoints compared between two animals.
SOCIAL_KEYPOINTS = ["NOSE", "BASE_NECK", "BASE_TAIL"]

# A point counts when its confidence is above this.
MIN_CONFIDENCE = 0.3
# Half of the field of view, degrees, inclusive.
HALF_FIELD_OF_VIEW = 120.0
# Default frame rate and window size (frames on each side).
DEFAULT_FPS = 30.0
DEFAULT_WINDOW = 5
# Frequency bands in Hz, low inclusive, high exclusive.
BANDS = [(0.1, 1.0), (1.0, 3.0), (3.0, 5.0), (5.0, 8.0), (8.0, 15.0)]
# Labelled frames a class needs on either side of a split.
LABEL_THRESHOLD = 20
# Default seed of training.
TRAINING_SEED = 0xAB3BDB
