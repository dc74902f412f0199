from .detectors import detect, detect_by_level, detect_classic, detect_sliding, detector_names, register_detector
from .evaluation import evaluate, rates
