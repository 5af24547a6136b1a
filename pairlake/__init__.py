"""pairlake: Spark-native operators for paired feature datasets.

Tables of files, images, tensors, embeddings, class labels and captions are
listed, paired, labelled, normalised, shuffled, batched and evaluated with
DataFrame plans.  Heavy work runs on executors; the driver only ever holds
O(D^2) statistics, O(#classes) or O(#partitions) values.
"""

from pairlake.session import build_session, checkpoint_dir, load_table

__all__ = ["build_session", "checkpoint_dir", "load_table"]
__version__ = "0.1.0"
