"""The four jobs: training, testing, verdicts, baseline."""
