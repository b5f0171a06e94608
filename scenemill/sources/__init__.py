"""Readers of scenes, predictions and meshes."""
