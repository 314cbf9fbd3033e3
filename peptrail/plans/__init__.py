"""Plans that join operators end to end: training and screening."""
