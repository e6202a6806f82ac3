"""Fixed values of the data model (17-keypoint skeleton, body regions, canonical chart)."""

CONF = 0.3

# fixed values: keypoint order
NOSE, LEYE, REYE, LEAR, REAR, LSH, RSH, LEL, REL, LWR, RWR, LHIP, RHIP, LKN, RKN, LANK, RANK = range(17)

# fixed values: body regions and the keypoint pairs that span their segments, in order
REGIONS = ["head", "torso", "arm", "hand", "leg", "foot"]
SEGMENTS = [("head", 3, 4), ("head", 0, 0),
            ("torso", 5, 6), ("torso", 11, 12), ("torso", 5, 11), ("torso", 6, 12),
            ("arm", 5, 7), ("arm", 6, 8), ("hand", 7, 9), ("hand", 8, 10),
            ("leg", 11, 13), ("leg", 12, 14), ("foot", 13, 15), ("foot", 14, 16)]

# fixed values: T-pose chart in body lengths, pelvis at the origin, y up
CHART = [(0, 1.45), (-0.06, 1.5), (0.06, 1.5), (-0.13, 1.45), (0.13, 1.45), (-0.4, 1.0), (0.4, 1.0), (-0.85, 1.0), (0.85, 1.0),
         (-1.3, 1.0), (1.3, 1.0), (-0.2, 0.0), (0.2, 0.0), (-0.22, -1.05), (0.22, -1.05), (-0.22, -2.05), (0.22, -2.05)]

# fixed values: limb directions and their weights in the posture distance
LIMBS = [("uarm_L", 5, 7, 1.0), ("farm_L", 7, 9, 0.7), ("thigh_L", 11, 13, 2.0), ("shin_L", 13, 15, 1.0),
         ("uarm_R", 6, 8, 1.0), ("farm_R", 8, 10, 0.7), ("thigh_R", 12, 14, 2.0), ("shin_R", 14, 16, 1.0)]
LEAN_WEIGHT, ANGLE_TOLERANCE = 2.0, 10.0

# fixed values: marker names of the 23-marker set and the markers averaged into each keypoint
MARKERS = ["LB Head", "LF Head", "RF Head", "RB Head", "Sternum", "L Shoulder", "R Shoulder", "L Elbow", "L Wrist", "L Hand", "R Elbow",
           "R Wrist", "R Hand", "Pelvis", "L Hip", "R Hip", "L Knee", "L Ankle", "L Foot", "R Knee", "R Ankle", "R Foot", "Thigh"]
MARKERS_OF_KEYPOINT = [("LF Head", "RF Head"), ("LF Head",), ("RF Head",), ("LB Head",), ("RB Head",), ("L Shoulder",), ("R Shoulder",),
                       ("L Elbow",), ("R Elbow",), ("L Wrist",), ("R Wrist",), ("L Hip",), ("R Hip",), ("L Knee",), ("R Knee",),
                       ("L Ankle",), ("R Ankle",)]

STATES = ["apart", "near", "contact", "share", "floor"]
