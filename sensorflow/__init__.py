"""Preparation and classification of wearable-sensor samples on Spark."""
