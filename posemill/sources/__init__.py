"""Readers and writers of feature tables, landmarks, manifests, profiles and reports."""
