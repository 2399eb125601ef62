"""Document-layout and document-text analytics as DataFrame programs."""
