"""Experiments: configuration, registry, runner, reports and the command line."""
