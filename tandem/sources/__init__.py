"""Readers and writers of artefacts, source trees and repositories."""
