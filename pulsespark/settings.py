"""Fixed values of the analytics: bands, plausible ranges and thresholds."""

# fixed values
IBI_RANGE = (0.3, 2.0)  # seconds
PULSE_BAND = (0.5, 3.3)  # Hz
HR_LIMITS = (50.0, 100.0)  # beats a minute
IRREGULAR = 0.1  # normalised RMSSD
BEAT_TOLERANCE = 0.15  # seconds
PREMATURITY, RECOVERY, CONTEXT, MAX_SHARE = 0.15, 0.95, 8, 0.2
FACING_MIN = 0.3
DARK, BRIGHT = (20.0, 45.0), (220.0, 245.0)
LUMA = (0.299, 0.587, 0.114)
SMOOTHNESS = 100.0
