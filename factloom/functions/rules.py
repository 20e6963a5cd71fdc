"""Fixed rule tables: component roles, modalities, declaration patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Role, label, phase, default modalities, priority, keywords.
ROLES = (
    ("vision_encoder", "Vision Encoder", "both", ("vision",), 10, ("vision_encoder", "visual_encoder", "image_encoder", "vision_backbone", "image_backbone", "resnet", "dino", "clip_vision", "vit")),
    ("language_encoder", "Language Encoder", "both", ("language",), 11, ("language_encoder", "text_encoder", "language_model", "text_model", "llm", "bert", "qwen")),
    ("proprioception_encoder", "Proprioception Encoder", "both", ("proprioception",), 12, ("proprio_encoder", "proprioception_encoder", "proprioceptive_encoder")),
    ("point_cloud_encoder", "Point-Cloud Encoder", "both", ("point_cloud",), 13, ("point_cloud_encoder", "pointcloud_encoder", "pointnet", "point_transformer")),
    ("tokenizer", "Tokenizer", "both", (), 20, ("tokenizer", "tokenization", "tokenize", "patch_embed", "patch_embedding")),
    ("multimodal_fusion", "Multimodal Fusion", "both", (), 30, ("multimodal_fusion", "cross_modal_fusion", "crossmodal_fusion", "cross_attention", "crossattention")),
    ("transformer_backbone", "Transformer Backbone", "both", (), 40, ("transformer", "attention_backbone", "transformer_backbone")),
    ("diffusion_denoiser", "Diffusion Denoiser", "both", (), 41, ("diffusion_denoiser", "denoiser", "noise_predictor", "noise_prediction", "diffusion_model", "unet")),
    ("world_model", "World Model", "both", (), 42, ("world_model", "dynamics_model", "latent_dynamics", "transition_model")),
    ("memory", "Memory", "both", (), 43, ("memory", "memory_bank", "episodic_memory", "kv_cache")),
    ("policy", "Policy", "inference", (), 50, ("policy", "actor", "policy_network", "policy_model")),
    ("action_head", "Action Head", "inference", ("action",), 51, ("action_head", "action_decoder", "action_projector", "action_prediction", "action_output")),
    ("classifier_head", "Classifier Head", "both", (), 52, ("classifier", "classification_head", "classifier_head", "logits_head")),
    ("planner", "Planner", "inference", (), 53, ("planner", "planning", "trajectory_planner", "motion_planner")),
    ("loss", "Loss", "training", (), 60, ("loss", "criterion", "objective", "loss_fn")),
    ("optimizer", "Optimizer", "training", (), 61, ("optimizer", "adam", "adamw", "sgd", "lion")),
    ("dataset", "Dataset", "both", (), 70, ("dataset", "dataloader", "data_loader", "sampler")),
    ("preprocessor", "Preprocessor", "both", (), 71, ("preprocess", "preprocessor", "augmentation", "augment", "transform_input")),
    ("postprocessor", "Postprocessor", "both", (), 72, ("postprocess", "postprocessor", "decode_output")),
    ("controller", "Controller", "inference", ("action",), 73, ("controller", "control_policy", "low_level_control", "pid_controller")),
    ("environment", "Environment", "inference", ("state",), 74, ("environment", "env_wrapper", "simulator", "simulation_env", "robot_env")),
    ("reward", "Reward", "training", ("reward",), 75, ("reward", "reward_model", "reward_fn")),
    ("generic_encoder", "Encoder", "both", (), 90, ("encoder", "encode")),
    ("generic_decoder", "Decoder", "both", (), 91, ("decoder", "decode")),
)

# Modality and its keywords.
MODALITIES = (
    ("vision", ("vision", "visual", "image", "rgb", "camera", "pixel", "resnet", "vit")),
    ("language", ("language", "text", "prompt", "instruction", "word", "llm", "bert", "qwen")),
    ("proprioception", ("proprio", "joint_state", "joint_position", "joint_pos", "ee_pose")),
    ("depth", ("depth", "depth_map", "rgbd")),
    ("point_cloud", ("point_cloud", "pointcloud", "pointnet", "point_transformer")),
    ("audio", ("audio", "speech", "waveform", "microphone")),
    ("state", ("state", "observation", "robot_state")),
    ("latent", ("latent", "embedding", "hidden_state")),
    ("action", ("action", "actuator", "motor_command")),
    ("reward", ("reward",)),
)
#: Modalities whose meeting makes a fusion (fixed values).
PRIMARY_MODALITIES = ("vision", "language", "proprioception", "depth", "point_cloud", "audio", "state")

# Declaration patterns of each role (case is ignored).
ROLE_PATTERNS = (
    ("vision_encoder", r"\b(?:vision|visual|image)[\s_-]*(?:encoder|backbone)\b|视觉编码器"),
    ("language_encoder", r"\b(?:language|text)[\s_-]*(?:encoder|model|backbone)\b|语言编码器"),
    ("multimodal_fusion", r"\b(?:multi[\s_-]*modal|cross[\s_-]*modal)[\s_-]*fusion\b|\bcross[\s_-]*attention\b|多模态融合|跨模态融合"),
    ("transformer_backbone", r"\btransformer\b|Transformer主干"),
    ("diffusion_denoiser", r"\b(?:diffusion|denoiser|denoising)\b|扩散模型|去噪器"),
    ("world_model", r"\bworld[\s_-]*model\b|世界模型"),
    ("memory", r"\b(?:memory|memory[\s_-]*bank)\b|记忆模块"),
    ("action_head", r"\baction[\s_-]*(?:head|decoder|projector)\b|动作头|动作解码器"),
    ("planner", r"\b(?:planner|planning[\s_-]*module)\b|规划器|规划模块"),
    ("controller", r"\bcontroller\b|控制器"),
    ("environment", r"\b(?:environment|env[\s_-]*wrapper)\b|环境模块"),
    ("tokenizer", r"\btokenizer\b|分词器|标记器"),
    ("policy", r"\bpolicy(?:[\s_-]*(?:network|model))?\b|策略网络"),
)
# Words that say whether weights change, and negations around a component.
FROZEN = r"\b(?:frozen|freeze|freezes|fixed[\s_-]*weights?)\b|冻结|固定参数"
TRAINABLE = r"\b(?:trainable|unfrozen|unfreeze|fine[\s_-]*tun(?:e|ed|ing)?)\b|可训练|微调"
NEGATED_BEFORE = r"(?:without|no|does\s+not\s+use|doesn't\s+use|do\s+not\s+use|not\s+using|不使用|没有|无)\s*(?:an?\s+|the\s+)?$"
NEGATED_AFTER = r"^\s*(?:is\s+not\s+used|is\s+absent|is\s+disabled|未使用|不存在)"

#: Directories that are never scanned (fixed values).
IGNORED_PARTS = (".git", ".hg", ".svn", ".venv", "venv", "__pycache__", "build", "dist", "site-packages", "node_modules")


def role_table(spark: SparkSession) -> DataFrame:
    """(role, role_label, phase, priority, keyword): one row a keyword."""
    return spark.createDataFrame([(r, label, phase, p, k) for r, label, phase, _, p, ks in ROLES for k in ks], "role string, role_label string, phase string, priority int, keyword string")


def modality_table(spark: SparkSession) -> DataFrame:
    """(modality, keyword)."""
    return spark.createDataFrame([(m, k) for m, ks in MODALITIES for k in ks], "modality string, keyword string")


def priority_of(role: str) -> int:
    return next((p for r, _, _, _, p, _ in ROLES if r == role), 999)
